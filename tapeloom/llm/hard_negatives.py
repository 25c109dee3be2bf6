"""Hard negatives: for an anchor and one of its nearest rows of the same label, the best rows of other labels that
score almost as high, found through one-bit codes and confirmed by exact integer scores.

Codes: a vector v is turned by a few random rotations; the signs of all coordinates are its code, and the code's
direction c (the signs turned back and averaged, scaled to length 1) is compared with v's: the alignment
t = <v, c> / |v| is stored with the code. For a query q, v = |v| (t c + s e) with s = sqrt(1 - t^2) and a unit vector e
across c, so by Cauchy-Schwarz <q, v> lies in |v| (t <q, c> -+ s sqrt(|q|^2 - <q, c>^2)), always. <q, c> comes from
popcounts: the turned query is rounded to a few bit planes, whose rounding error, as a length, widens the interval.
Candidates whose interval can't reach the best ones' or the asked-for band are left out; what is left is scored by
integer products. So the intervals only save work: results are exact.

Spark deals rows out by a hash of vec_id; every task reads all anchors block by block from the shared folder and
sends on its best rows for each anchor (at most as many as are asked for), which Spark merges. Anchors are a stated query set.
A task holds one slab of rows and one block of anchors, and compares them tile by tile: the best rows so far bound what the
next tile's intervals have to reach. Its memory goes by the sizes of slab and tile, not by the table's.

Cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; of rows with one
vec_id the first by label and vector takes part; shorter vectors count as filled up with zeros (an
empty one scores 0); components beyond +-2**27 once scaled would not fit the scores and take no part; ties go to
the lesser vec_id; a table without anchors, or an empty one, gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.llm import shared
from tapeloom.llm.token_files import open_dir, put

#: Rotations that make a code, bit planes of a rounded query, components of a task's rows held at once, anchors of a block,
#: pairs of a tile, components that are turned or multiplied at once.
ROTATIONS = 4
PLANES = 6
SLAB = 1 << 22
BLOCK = 256
TILE = 1 << 18
STEP = 1 << 20
_LARGEST = 2.0**27
ROWS = "vec_id long, label int, ints binary, code binary, norm double, alignment double"


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and ints (floor(scale x) of each component) of the rows that take part, once each vec_id."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")) <= _LARGEST, F.lit(False)) & ~F.isnan(x))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").dropna().filter(fine)
    return kept.select("vec_id", "label", whole.alias("ints")).groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("r")).select("vec_id", "r.*")


def rotations(d: int) -> np.ndarray:
    """Random orthogonal d x d matrices, one above the other, over the root of their number: columns have length 1."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(ROTATIONS)]) / np.sqrt(ROTATIONS)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words, filled up with zeros."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def code(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64-bit words), lengths and alignments of vectors."""
    bits = vectors @ turn.T >= 0
    signs = np.where(bits, 1.0, -1.0)
    back = signs @ turn
    norm = np.sqrt((vectors * vectors).sum(1))
    size = np.sqrt((back * back).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        t = (vectors * back).sum(1) / (norm * size)
    return _words(bits), norm, np.where(norm > 0, np.minimum(t, 1.0), 1.0)


def _steps(n: int, width: int) -> range:
    """Starts of runs of n rows of so many components, and the runs' length as step."""
    return range(0, n, max(1, STEP // max(1, width)))


class Rounded:
    """Queries (rows), turned and rounded to bit planes, the highest first."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray):
        turned = queries @ turn.T
        low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
        self.low, self.step = low, np.where(high > low, (high - low) / (2**PLANES - 1), 1.0)
        level = np.rint((turned - low) / self.step).astype(np.int64)
        self.planes = [_words((level >> p) & 1 > 0) for p in reversed(range(PLANES))]
        self.error = np.sqrt(((turned - low - self.step * level) ** 2).sum(1))[:, None]
        self.total = (low + self.step * level).sum(1)[:, None]
        self.length = np.sqrt((queries * queries).sum(1))[:, None]


class Codes:
    """Rows with codes, as arrays."""

    def __init__(self, table: pa.Table, d: int):
        self.ids, self.labels, self.norm, self.alignment = (table.column(c).to_numpy() for c in ("vec_id", "label", "norm", "alignment"))
        n = len(self.ids)
        flat = lambda c, t, w: np.frombuffer(b"".join(table.column(c).to_pylist()), t).reshape(n, w)
        words = -(-ROTATIONS * d // 64)
        self.ints, self.code = flat("ints", "<i4", d), flat("code", "<u8", words)
        self.turn = rotations(d)
        # the length of the signs turned back, from the code itself
        self.size, self.ones = np.empty(n), np.bitwise_count(self.code).sum(1, dtype=np.int32)
        for i in (runs := _steps(n, ROTATIONS * d)):
            bits = np.unpackbits(self.code[i : i + runs.step].view(np.uint8), axis=1, bitorder="little")[:, : ROTATIONS * d]
            self.size[i : i + runs.step] = np.sqrt((((2.0 * bits - 1) @ self.turn) ** 2).sum(1))
        self.residual = np.sqrt(np.maximum(0.0, 1 - self.alignment**2))

    def tiles(self, queries: int) -> list[slice]:
        """The rows in parts that make a tile with so many queries."""
        n, step = len(self.ids), max(1, TILE // max(1, queries))
        return [slice(i, min(n, i + step)) for i in range(0, n, step)]

    def intervals(self, queries: np.ndarray | Rounded, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the products of each query (rows) with each of some rows (columns)."""
        q = queries if isinstance(queries, Rounded) else Rounded(queries, self.turn)
        codes, norm, alignment = self.code[rows], self.norm[rows], self.alignment[rows]
        weighted = np.zeros((len(q.low), len(codes)), np.int32)
        common, count = np.empty(weighted.shape, np.uint64), np.empty(weighted.shape, np.uint8)
        for plane in q.planes:
            weighted <<= 1
            for w in range(plane.shape[1]):
                np.bitwise_and(plane[:, w, None], codes[None, :, w], out=common)
                weighted += np.bitwise_count(common, out=count)
        signs = 2 * (q.low * self.ones[None, rows] + q.step * weighted) - q.total  # <rounded query, signs>
        # an error of the turned query shifts its product with the signs by at most its length times theirs
        size = np.maximum(self.size[rows], 1e-300)[None, :]
        along, slack = signs / size, q.error * np.sqrt(codes.shape[1] * 64) / size
        across = np.sqrt(np.maximum(0.0, q.length**2 - np.maximum(0.0, np.abs(along) - slack) ** 2))
        middle = norm * alignment * along
        width = norm * (np.abs(alignment) * slack + self.residual[rows] * across) + 1e-6 * (1 + norm * q.length)
        return middle - width, middle + width

    def scores(self, queries: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products of pairs of queries and rows (places of both)."""
        out = np.empty(len(rows), np.int64)
        for i in (runs := _steps(len(rows), queries.shape[1])):
            at = slice(i, i + runs.step)
            out[at] = np.einsum("ij,ij->i", queries[asked[at]].astype(np.int64), self.ints[rows[at]].astype(np.int64))
        return out


def _packed(vectors: np.ndarray) -> pa.Array:
    """Rows of integers as blobs of 32-bit ones."""
    return pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary())


def coded(rows: DataFrame) -> tuple[DataFrame, int]:
    """Stored rows with codes (ROWS), dealt out by a hash of vec_id, and the number of components."""
    shared.short_batches(rows.sparkSession)
    rows = shared.materialize(rows)
    d, n = rows.agg(F.coalesce(F.greatest(F.max(F.size("ints")), F.lit(1)), F.lit(1)), F.count("*")).first()

    def run(batches):
        turn = rotations(d)
        for batch in batches:
            for i in (runs := _steps(batch.num_rows, ROTATIONS * d)):
                part = batch.slice(i, runs.step)
                lists = part.column(2)
                values, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
                whole = np.zeros((part.num_rows, d))
                size = np.diff(at)
                whole[np.repeat(np.arange(part.num_rows), size), np.arange(len(values)) - np.repeat(at[:-1], size)] = values
                bits, norm, t = code(whole, turn)
                yield shared.arrow(vec_id=part.column(0), label=part.column(1), ints=_packed(whole), code=pa.array([b.tobytes() for b in bits], pa.binary()), norm=norm, alignment=t)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * d // SLAB))
    return shared.materialize(rows.repartition(parts, "vec_id").mapInArrow(run, ROWS), rows), d


def _anchor_files(anchors: DataFrame) -> tuple[str, list[int]]:
    """Write anchors (vec_id, label, ints, and positive_scores if any) as files, a block each; their folder and numbers."""
    uri = shared.shared_dir(anchors.sparkSession)
    n = anchors.count()

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
        files, top = open_dir(uri)
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, t.schema) as w:
                w.write_table(t)
            put(files, f"{top}/{part:07d}", out.getvalue().to_pybytes())
        yield shared.arrow(part=np.array([part], np.int64))

    made = shared.materialize(anchors.repartition(max(1, -(-n // BLOCK)), "vec_id").mapInArrow(run, "part long"))
    return uri, sorted(r[0] for r in made.collect())  # one row a block of anchors


def _blocks(uri: str, parts: list[int], d: int):
    files, top = open_dir(uri)
    for part in parts:
        with files.open_input_file(f"{top}/{part:07d}") as f:
            t = pa.ipc.open_stream(f).read_all()
        yield t, np.frombuffer(b"".join(t.column("ints").to_pylist()), "<i4").reshape(t.num_rows, d).astype(np.float64)


def _slabs(batches, d: int):
    held, n, most = [], 0, max(1, SLAB // max(1, d))
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, most - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == most:
                yield Codes(pa.Table.from_batches(held), d)
                held, n = [], 0
    if n:
        yield Codes(pa.Table.from_batches(held), d)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row (-inf if there are fewer)."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def _best(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by score descending, then id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    first = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1)) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < k]


class Best:
    """The first k of each of n groups by score descending, then id, of what was added so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.reach = n, k, np.full(n, -np.inf)
        self.group, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def bound(self, low: np.ndarray, there: np.ndarray) -> np.ndarray:
        """What a score has to reach, as those ``there`` have at least ``low``."""
        return self.reach if (self.reach > -np.inf).all() else np.maximum(self.reach, _kth(np.where(there, low, -np.inf), self.k))

    def add(self, group: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.reach[group]
        if not good.any():
            return
        g, s, i = (np.concatenate(x) for x in ((self.group, group[good]), (self.scores, scores[good]), (self.ids, ids[good])))
        at = _best(g, s, i, self.k)
        self.group, self.scores, self.ids = g[at], s[at], i[at]
        count = np.bincount(self.group, minlength=self.n)
        full = count == self.k
        self.reach[full] = self.scores[(np.cumsum(count) - 1)[full]]


def positives(rows: DataFrame, d: int, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, score, i): the first k other rows of each anchor's label."""
    uri, parts = _anchor_files(anchors)

    def run(batches):
        for slab in _slabs(batches, d):
            for t, q in _blocks(uri, parts, d):
                ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
                asked, best = Rounded(q, slab.turn), Best(len(q), k)
                for tile in slab.tiles(len(q)):
                    low, high = slab.intervals(asked, tile)
                    same = (labels[:, None] == slab.labels[None, tile]) & (ids[:, None] != slab.ids[None, tile])
                    a, r = np.nonzero(same & (high >= best.bound(low, same)[:, None]))
                    r += tile.start
                    best.add(a, slab.scores(q, a, r), slab.ids[r])
                yield shared.arrow(anchor_id=ids[best.group], positive_id=best.ids, score=best.scores)

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, score long")
    return found.withColumn("i", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))).filter(F.col("i") <= k)


def negatives(rows: DataFrame, d: int, anchors: DataFrame, k: int, low_share: int, high_share: int) -> DataFrame:
    """(anchor_id, i, negative_id, score, rank) of the first k rows of other labels within the band of each anchor's i-th positive."""
    uri, parts = _anchor_files(anchors)

    def run(batches):
        for slab in _slabs(batches, d):
            for t, q in _blocks(uri, parts, d):
                ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
                found = t.column("positive_scores").to_pylist()
                scored = [np.array([f[i] if len(f) > i else -1 for f in found], np.int64) for i in range(max(map(len, found), default=0))]
                asked, bests = Rounded(q, slab.turn), [Best(len(q), k) for _ in scored]
                for tile in slab.tiles(len(q)):
                    low, high = slab.intervals(asked, tile)
                    other = labels[:, None] != slab.labels[None, tile]
                    needed = np.zeros(other.shape, bool)
                    for whole, best in zip(scored, bests):
                        p = whole.astype(np.float64)[:, None]
                        bottom, top, wide = p * low_share / 100, p * high_share / 100, 1e-9 * (1 + np.abs(p))
                        sure = other & (low >= bottom + wide) & (high <= top - wide)  # within the band whatever their score
                        needed |= other & (high >= bottom - wide) & (low <= top + wide) & (high >= best.bound(low, sure)[:, None]) & (p >= 0)
                    a, r = np.nonzero(needed)
                    r += tile.start
                    s = slab.scores(q, a, r)
                    for p, best in zip(scored, bests):
                        there = (p[a] >= 0) & (low_share * p[a] <= 100 * s) & (100 * s <= high_share * p[a])
                        best.add(a[there], s[there], slab.ids[r[there]])
                for i, best in enumerate(bests):
                    yield shared.arrow(anchor_id=ids[best.group], i=np.full(len(best.ids), i + 1, np.int32), negative_id=best.ids, score=best.scores)

    found = rows.mapInArrow(run, "anchor_id long, i int, negative_id long, score long")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("anchor_id", "i").orderBy(F.desc("score"), "negative_id"))).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low_share: int = 80, high_share: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; is_anchor: a condition on vec_id. The n_positives best other rows of an anchor's label are its positives; for
    each, the n_negatives best rows of other labels whose score is between low_share and high_share percent of the positive's.
    A positive of a score below 0 has an empty band for shares up to 100."""
    rows, d = coded(usable(vectors, scale))
    anchors = rows.filter(is_anchor).select("vec_id", "label", "ints")
    best = shared.materialize(positives(rows, d, anchors, n_positives))
    per = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("i", "score"))).alias("p")).select(F.col("anchor_id").alias("vec_id"), F.col("p.score").alias("positive_scores"))  # n_positives each
    found = negatives(rows, d, anchors.join(per, "vec_id"), n_negatives, low_share, high_share)
    out = found.withColumnRenamed("score", "negative_score").join(best.select("anchor_id", "i", "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "i"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
