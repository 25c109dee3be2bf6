"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles. All sets are ordered alike: by class of
estimated frequency (a mergeable count sketch over the whole corpus), then by hash. A pair of
similarity t that shares the order has, in prefixes of n - ceil(t n) + l tokens, at least l common
ones, whatever l each side takes (the lesser counts). Each document takes the l of least estimated
cost: tokens scanned plus candidates that so many shared tokens still let through. The sizes and
the rest behind the prefixes raise the number of matches a pair needs further.

Equal sets are one class with one representative. Candidates of a token are not all its pairs:
every document is first compared with the token's hub (the document with the most common prefix),
which links most of a group in linear work; then only documents outside the hub's component are
compared, with those that sizes and match counts still allow, so no link is lost. Candidates are
verified on whole sets. Components are those of verified links and class memberships.

Cases: null or empty texts have empty sets and link with nothing; fewer than five words are one
shingle; repeated rows are reported each; a null doc_id has no component; ids are read as whole numbers;
extra columns are ignored by ``join`` and kept by ``keep_first``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.components import components

K = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bits of the count sketch; raise with the corpus (its noise is the number of tokens / 2**bits).
SKETCH_BITS = 20
_PARTS = 16
MOST_MATCHES = 8
VERIFY_COST = 16.0
#: Earlier tokens of its document that a row carries, so that a pair that met there is not looked up again.
EARLIER = 4


def _sets(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, at = shared.shingles(*shared.word_hashes(raw, bounds), K)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def summarize(docs: DataFrame, bits: int) -> DataFrame:
    """Per document n and a 128-bit signature of its set (part is null); per task the sketch's parts."""

    def run(batches):
        sketch = np.zeros(1 << bits, np.int32)
        for batch, raw, bounds in shared.chunks(batches):
            n, one, two = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            sets = _sets(raw, bounds)
            for d, s in enumerate(sets):
                n[d] = len(s)
                one[d] = np.add.reduce(shared.mix(s), dtype=np.uint64)
                two[d] = np.bitwise_xor.reduce(shared.mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0))
            if sets:
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
            nothing = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), nothing.cast(pa.int32()), nothing.cast(pa.binary())], _NAMES)
        if sketch.any():
            many, blobs = pa.nulls(_PARTS, pa.int64()), [x.tobytes() for x in np.split(sketch, _PARTS)]
            yield pa.RecordBatch.from_arrays([many, many, many, many, pa.array(range(_PARTS), pa.int32()), pa.array(blobs, pa.binary())], _NAMES)

    return docs.mapInArrow(run, "doc_id long, n long, one long, two long, part int, blob binary")


_NAMES = ["doc_id", "n", "one", "two", "part", "blob"]


def frequencies(summary: DataFrame, bits: int) -> np.ndarray:
    """The merged sketch (2**bits counts, whatever the input)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // _PARTS, np.int64)
        for blob in pdf["blob"]:
            total += np.frombuffer(blob, np.int32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [total.astype("<i8").tobytes()]})

    rows = summary.filter("part is not null").select("part", "blob").groupBy("part").applyInPandas(add, "part int, blob binary").collect()  # _PARTS rows
    out = np.zeros((_PARTS, (1 << bits) // _PARTS), np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["blob"], "<i8")
    return out.ravel()


def prefixes(docs: DataFrame, counts: np.ndarray, bits: int) -> DataFrame:
    """Rows (token, doc, n, l): each document's prefix for its own number of matches l."""
    noise = max(1.0, counts.sum() / len(counts))
    shipped = docs.sparkSession.sparkContext.broadcast((np.log2(np.maximum(counts / noise, 1.0)).astype(np.uint8), np.maximum(counts - noise, 0).astype(np.float32)))

    def run(batches):
        level, excess = shipped.value
        for batch, raw, bounds in shared.chunks(batches):
            tokens, docs_, ns, ls = [], [], [], []
            for d, s in enumerate(_sets(raw, bounds)):
                n = len(s)
                if not n:
                    continue
                place = (s >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(level[place], kind="stable")
                need = -(-PERCENT * n // 100)
                first = n - need + 1
                most = min(MOST_MATCHES, need)
                scanned = np.cumsum(excess[place[order[: first + most - 1]]], dtype=float)[first - 1 :]
                many = int(np.argmin(scanned * (1 + VERIFY_COST / np.arange(1, most + 1)))) + 1
                chosen = s[order[: first + many - 1]]
                tokens.append(chosen)
                docs_.append(np.full(len(chosen), d))
                ns.append(np.full(len(chosen), n, np.int32))
                ls.append(np.full(len(chosen), many, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(shared.signed(np.concatenate(tokens))), batch.column(0).take(pa.array(np.concatenate(docs_))), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ls))], ["token", "doc", "n", "l"])

    return docs.mapInArrow(run, "token long, doc long, n int, l int")


def _need(n1: Column, n2: Column) -> Column:
    """Least intersection of linked sets of these sizes."""
    return F.ceil((n1 + n2) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)


def _rest(n: Column, many: Column) -> Column:
    """Tokens behind the prefix."""
    return F.ceil(n * PERCENT / F.lit(100.0) - 1e-9) - many


def matches_needed(n1: Column, l1: Column, n2: Column, l2: Column) -> Column:
    """Matches in the prefixes without which a pair can't be linked."""
    return F.greatest(F.least(l1, l2), _need(n1, n2) - F.greatest(_rest(n1, l1), _rest(n2, l2)))


def _sizes_fit(n1: Column, n2: Column) -> Column:
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2))


def _counted(pairs: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) with enough common prefix tokens."""
    grouped = pairs.groupBy("a", "b").agg(F.count("*").alias("q"), *(F.first(c).alias(c) for c in ("na", "la", "nb", "lb")))
    return grouped.filter(F.col("q") >= matches_needed(F.col("na"), F.col("la"), F.col("nb"), F.col("lb"))).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    who = shared.materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def pack(batches):
        for batch, raw, bounds in shared.chunks(batches):
            blobs = [s.astype("<u8").tobytes() for s in _sets(raw, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc", "tokens"])

    sets = shared.materialize(docs.join(shared.small(who), "doc_id", "left_semi").mapInArrow(pack, "doc long, tokens binary"), who)

    def compare(batches):
        for batch in batches:
            keep, last, held = np.zeros(batch.num_rows, bool), None, None
            a_ids, one, two = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (x, a, b) in enumerate(zip(a_ids, one, two, strict=True)):
                if x != last or a != held[0]:
                    last, held = x, (a, np.frombuffer(a, "<u8"))
                a, b = held[1], np.frombuffer(b, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= PERCENT * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    of = lambda side, name: sets.select(F.col("doc").alias(side), F.col("tokens").alias(name))
    both = pairs.join(of("b", "two"), "b").select("a", "b", "two").join(of("a", "one"), "a").select("a", "b", "one", "two")
    return shared.materialize(both.mapInArrow(compare, "a long, b long").distinct(), sets)


def _apart(held: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates between documents that share a token but no component yet.

    Rows (token, doc) stay only while some size in the token's list still allows a link, and tokens
    only while they hold several components. All pairs are covered: a pair that needs q matches has its first common token, rarest first, where both sides
    have q tokens left, and is looked up there alone.
    """
    found = components(links)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    part = shared.materialize(found.join(sizes, "component").select(F.col("node").alias("doc"), "component", "size"), found)
    parts, part = [part], shared.small(part)
    placed = held.join(part, "doc", "left").withColumn("part", F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "doc").alias("id"))).drop("size", "component")
    about = shared.materialize(placed.groupBy("token").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("part").alias("main"), F.min("part").alias("other")).filter("main != other").drop("other"))
    n, many = F.col("n"), F.col("l")
    ends = [F.greatest(F.col("low"), F.ceil(n * PERCENT / 100.0 - 1e-9)), F.least(F.col("high"), F.floor(n * 100.0 / PERCENT + 1e-9))]
    # a partner with l = 1 has the longest rest; 2 is for rounding between the ends
    least = F.least(*(_need(n, e) - F.greatest(_rest(n, many), _rest(e, F.lit(1))) for e in ends)) - 2
    alive = shared.materialize(placed.join(about, "token").withColumn("least", F.greatest(least, F.lit(1))).filter("m >= least").drop("low", "high"), about, *parts)
    mixed = shared.materialize(alive.groupBy("token").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("main")).filter("low != main").select("token", "df", "main"))
    rows = shared.materialize(alive.drop("main").join(mixed, "token"), alive, mixed)
    n1, n2, l1, l2 = (F.col(c) for c in ("n1", "n2", "l1", "l2"))
    # In the order of (df, token), which all share, a linked pair's first common token leaves each side enough tokens.
    # Where an earlier common token is known, the pair has met at that one, with more tokens left.
    per_doc = Window.partitionBy("doc")
    in_order = per_doc.orderBy("df", "token")
    left = F.count("*").over(per_doc) - F.row_number().over(in_order) + 1
    earlier = F.collect_list("token").over(in_order.rowsBetween(-EARLIER, -1))
    ranked = shared.materialize(rows.withColumns({"left": left, "earlier": earlier}).filter("left >= least"))
    side = lambda df, i: df.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("doc", "n", "l", "left", "part", "earlier")))
    enough = F.least("left1", "left2") >= matches_needed(n1, l1, n2, l2)
    cross = side(ranked.filter("part != main"), 1).join(side(ranked, 2), "token").filter((F.col("part1") < F.col("part2")) & _sizes_fit(n1, n2) & enough & ~F.arrays_overlap("earlier1", "earlier2"))
    pairs = shared.materialize(cross.select("doc1", "doc2", "n1", "l1", "n2", "l2").distinct(), ranked)
    lists = shared.materialize(rows.groupBy("doc").agg(F.collect_list("token").alias("tokens")), rows)  # a prefix at most
    first, second = (lists.select(F.col("doc").alias(f"doc{i}"), F.col("tokens").alias(f"tokens{i}")) for i in (1, 2))
    both = pairs.join(first, "doc1").join(second, "doc2").filter(F.size(F.array_intersect("tokens1", "tokens2")) >= matches_needed(n1, l1, n2, l2))
    return shared.materialize(both.select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b")).distinct(), pairs, lists)


def link(docs: DataFrame, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of every row, and links (a, b): class memberships and verified pairs that join up every component.

    Pairs of different texts in a component that its hubs have already joined are not looked up: the links span components, they are not all pairs."""
    docs = shared.text_of(docs)
    summary = shared.materialize(summarize(docs, bits))
    counts = frequencies(summary, bits)
    sizes = shared.materialize(summary.filter("part is null").select("doc_id", "n", "one", "two"), summary)
    with_id = sizes.filter("doc_id is not null and n > 0")
    copied = shared.materialize(with_id.groupBy("n", "one", "two").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most")).filter("a < most").drop("most"))
    members = shared.materialize(with_id.join(shared.small(copied), ["n", "one", "two"]).select("a", F.col("doc_id").alias("b")).filter("a != b").distinct(), copied)
    versions = shared.materialize(with_id.select("doc_id", "n", "one", "two").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id"))  # ids of several texts stay
    copies = shared.materialize(members.select(F.col("b").alias("doc_id")).join(versions, "doc_id", "left_anti"), versions)
    own = docs.filter("doc_id is not null").join(shared.small(copies), "doc_id", "left_anti")

    rows = shared.materialize(prefixes(own, counts, bits))
    often = shared.materialize(rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    common = shared.materialize(rows.join(often.hint("shuffle_hash"), "token"), rows, often, copies)
    per_doc = shared.materialize(common.groupBy("doc").agg((F.sum(F.log2("df")) / F.max("n")).alias("centre"), F.count("*").alias("m")))
    held = shared.materialize(common.join(per_doc, "doc").drop("df"), common, per_doc)
    hub = F.max(F.struct("centre", (-F.col("doc")).alias("least"), "n", "l", "m")).alias("hub")
    hubs = shared.materialize(held.groupBy("token").agg(hub).select("token", (-F.col("hub.least")).alias("a"), F.col("hub.n").alias("na"), F.col("hub.l").alias("la"), F.col("hub.m").alias("ma")))
    side = held.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("m").alias("mb"))
    na, nb, la, lb, ma, mb = (F.col(c) for c in ("na", "nb", "la", "lb", "ma", "mb"))
    may = _sizes_fit(na, nb) & (F.least(ma, mb) >= matches_needed(na, la, nb, lb))
    first = shared.materialize(_counted(side.join(hubs, "token").filter((F.col("a") != F.col("b")) & may)), hubs)
    links = verify(first, docs)

    # What the hubs left apart.
    apart = _apart(held, links)
    shared.discard(first, held)
    links = shared.materialize(links.unionByName(verify(apart, docs)), links, apart)
    out = sizes.select("doc_id", "n")
    out._stored_at = sizes._stored_at
    return out, shared.materialize(members.unionByName(links), members, links)


def join(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sizes, links = link(docs, bits)
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    return sizes.join(shared.small(found), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """The document of least id of each component, and all without words or id; docs' own columns."""
    sizes, links = link(docs, bits)
    found = components(links)
    extra = shared.materialize(found.filter("component != node").select(F.col("node").alias("doc_id")), found, links, sizes)
    return docs.join(shared.small(extra), "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS q FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * q >= 75 * (x.n + y.n - q)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
