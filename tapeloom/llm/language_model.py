"""Interpolated modified Kneser-Ney n-gram model of any order from two, three unless told otherwise.

Counting, in Spark: (1) word counts, aggregated in each task, go by hash range to reducers, which
write sorted hash and count arrays; a word's place over all arrays is its number. (2) level by
level, an m-gram's key is the number of its first m - 1 words as an (m - 1)-gram and that of its
last word, in one 64-bit integer (as many low bits for the word as the vocabulary needs). Keys and
counts go by key range, with boundaries at equal shares of the counted (m - 1)-grams, so that a
frequent context is split over files; reducers write sorted key and count arrays, and a key's
place over all of them is the m-gram's number. (3) each m-gram counts once for the (m - 1)-gram
that it ends in: these continuation counts are summed by range of numbers and stand, below the
highest level, in place of counts (m-grams that begin a text keep their counts, as nothing can
stand before them), and give the figures of each context. Arrays are files in the shared folder,
which workers map into memory to score. A shard holds about SHARD_BYTES of text.

P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u) * P(w | u'), u'
being u without its first word; words themselves are interpolated with the uniform 1 / (V + 1). A
context never met leaves all to the shorter one. Discounts are the usual functions of the counts
of counts of a level. Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; each text ends with an end
token and starts behind a start token, which is never predicted.

Limits: the bits of a word's number and of an m-gram's number are 64 together, else an error.

Cases: null and empty texts are the end token alone; rows of null or repeated ids are scored each (a
null id counts as training text); without training text P is uniform; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.token_files import mapped, open_dir, put

END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Tokens counted in a task before its m-grams are sent on.
HOLD = 3_000_000
#: Text behind one shard of the arrays.
SHARD_BYTES = 128 << 20
#: Points at equal shares of a shard's counts, from which the next level's ranges are chosen.
MARKS = 64


def tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END behind each text's words, and the texts' offsets."""
    words, at = shared.word_hashes(raw, bounds)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values (as differences) and counts, compressed."""
    small = np.dtype("<u1") if counts.max(initial=0) < 256 else np.dtype("<u8")
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return small.str[2].encode() + pa.compress(planes + counts.astype(small).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    width = int(blob[:1])
    data = pa.decompress(blob[1:], decompressed_size=n * (8 + width), codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * 8).reshape(8, n).T).view("<u8").ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=np.uint64), np.frombuffer(data, f"<u{width}", n, n * 8).astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _blobs(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and counts cut at bounds (the first key of each range but the first)."""
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    rows = [(i, b - a, _packed(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "blob"])


_BLOBS = "part int, n long, blob binary"


def _together(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_unpacked(b, n) for b, n in zip(pdf["blob"], pdf["n"], strict=True) if b is not None]
    pairs = pairs or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return _merged([p[0] for p in pairs], [p[1] for p in pairs])


def _put_counts(files, top: str, name: str, part: int, counts: np.ndarray) -> str:
    """Write counts in as few bytes as they take; their type.

    Behind a type with a plus, counts of 255 and more stand as 255, and their places and values in a file of their own.
    """
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(t).max)
    large = np.flatnonzero(counts >= 255)
    if len(counts) + 16 * len(large) < np.dtype(kind).itemsize * len(counts):
        kind = "<u1+"
        put(files, f"{top}/{name}+-{part:05d}", np.concatenate((large, counts[large])).astype("<i8").tobytes())
        counts = np.minimum(counts, 255)
    put(files, f"{top}/{name}-{part:05d}", counts.astype(kind.rstrip("+")).tobytes())
    return kind


class Arrays:
    """A folder's sorted arrays, mapped by a worker when first used."""

    def __init__(self, uri: str, parts: dict[int, dict]):
        self.files, self.top = open_dir(uri)
        self.parts, self.open = parts, {}

    def get(self, part: int, name: str) -> np.ndarray:
        if (part, name) not in self.open:
            kind = "<i8" if name.endswith("+") else self.parts[part][name].rstrip("+")
            self.open[part, name] = mapped(self.files, f"{self.top}/{name}-{part:05d}", kind)
        return self.open[part, name]

    def at(self, part: int, name: str, places: np.ndarray) -> np.ndarray:
        """What _put_counts() wrote for some places."""
        out = np.asarray(self.get(part, name)[places]).astype(np.int64)
        if self.parts[part][name].endswith("+"):
            where, values = self.get(part, f"{name}+").reshape(2, -1)
            large = np.flatnonzero(out == 255)
            out[large] = values[np.searchsorted(where, places[large])]
        return out


class Vocabulary:
    """Numbers of words: their places in the sorted hashes of all parts."""

    def __init__(self, uri: str, parts: dict[int, dict], shards: int):
        self.arrays, self.shards = Arrays(uri, parts), shards
        self.base = np.zeros(shards + 1, np.int64)
        for p in range(shards):
            self.base[p + 1] = self.base[p] + (parts[p]["n"] if p in parts else 0)
        self.bounds = hash_bounds(shards)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each of some sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = [0, *np.searchsorted(hashes, self.bounds).tolist(), len(hashes)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a and p in self.arrays.parts:
                keys = self.arrays.get(p, "hash")
                at = np.searchsorted(keys, hashes[a:b])
                hit = np.flatnonzero(np.asarray(keys[np.minimum(at, len(keys) - 1)]) == hashes[a:b])
                number[a + hit] = self.base[p] + at[hit]
                count[a + hit] = self.arrays.at(p, "count", at[hit])
        return number, count

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(words, return_inverse=True)
        number, count = self.numbers(distinct)
        return number[back], count[back]

    def part_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, numbers, "right") - 1


def hash_bounds(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


class Grams:
    """Numbers of m-grams: the places of their keys in the sorted arrays of a level's parts."""

    def __init__(self, uri: str, level: dict):
        self.arrays, self.ranges, self.level = Arrays(uri, level["parts"]), level["ranges"], level
        sizes = [level["parts"].get(p, {"n": 0})["n"] for p in range(len(self.ranges) + 1)]
        self.base = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.key = f"key{level['m']}"

    def spans(self, keys: np.ndarray):
        """(part, from, to) of sorted keys, for parts that have files."""
        cuts = [0, *np.searchsorted(keys, self.ranges).tolist(), len(keys)]
        return [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a and p in self.arrays.parts]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Number (-1: none) of each of some sorted distinct keys."""
        out = np.full(len(keys), -1, np.int64)
        for p, a, b in self.spans(keys):
            have = self.arrays.get(p, self.key)
            at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
            hit = np.flatnonzero(np.asarray(have[at]) == keys[a:b])
            out[a + hit] = self.base[p] + at[hit]
        return out

    def take(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """An array's entries at some numbers."""
        out = np.zeros(len(numbers), np.uint64)
        part = np.searchsorted(self.base, numbers, "right") - 1
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            out[at] = self.arrays.get(int(p), name)[numbers[at] - self.base[p]]
        return out

    def counts(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """What _put_counts() wrote, for some numbers."""
        out = np.zeros(len(numbers), np.int64)
        part = np.searchsorted(self.base, numbers, "right") - 1
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            out[at] = self.arrays.at(int(p), name, numbers[at] - self.base[p])
        return out


def _before(have: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """For each token the number of what ends right before it; first at the start of a text."""
    before = np.concatenate(([first], have[:-1]))[: len(have)]
    before[at[:-1]] = first
    return before


def _keys(before: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens have a known context, and the keys there; an unknown word gets a number that no file holds."""
    known = np.flatnonzero(before >= 0)
    word = np.where(number[known] >= 0, number[known], (1 << bits) - 1).astype(np.uint64)
    return known, (before[known].astype(np.uint64) << np.uint64(bits)) | word


def _figures(context: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, list[int]]:
    """First context, the sums (all, ones, twos, more) of each number from it to the last one, and the two at the ends."""
    low = int(context[0])
    begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sums = np.zeros((int(context[-1]) - low + 1, 4), np.int64)
    for i, x in enumerate((counts, counts == 1, counts == 2, counts >= 3)):
        sums[context[begin] - low, i] = np.add.reduceat(x.astype(np.int64), begin)
    return low, sums, [low, *sums[0].tolist(), int(context[-1]), *sums[-1].tolist()]


def _types(counts: np.ndarray) -> list[int]:
    """Numbers of types counted once to four times."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _marks(counts: np.ndarray) -> tuple[list[int], list[float]]:
    """Places at equal shares of the counts, and how far into the item there the share ends."""
    sums = np.cumsum(counts, dtype=np.int64)
    want = sums[-1] * np.arange(1, MARKS + 1) / MARKS
    at = np.minimum(np.searchsorted(sums, want), len(sums) - 1)
    return at.tolist(), (1 - (sums[at] - want) / counts[at]).tolist()


def _ranges(points: list[tuple[int, float, float]], shards: int, bits: int, size: int) -> np.ndarray:
    """Keys that cut (number, share of it, weight) points in ascending order into shards of about equal weight."""
    weights = np.cumsum([w for _, _, w in points])
    if not len(weights):
        return np.zeros(0, np.uint64)
    at = np.searchsorted(weights, weights[-1] * np.arange(1, shards) / shards)
    return np.array(sorted((points[i][0] << bits) | int(points[i][1] * max(0, size - 1)) for i in at.tolist()), np.uint64)


def _discounts(n: np.ndarray) -> list[float]:
    """D1, D2, D3+ from the numbers of types seen once to four times."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 1e-3), i + 0.999) for i, x in enumerate(d)]


def train(docs: DataFrame, shards: int | None = None, order: int = 3) -> dict:
    """Count and write the model of all docs; what workers need to open it (a few hundred bytes a shard and level)."""
    if order < 2:
        raise ValueError("an order of two or more")
    spark = docs.sparkSession
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    uri = shared.shared_dir(spark)
    bounds = hash_bounds(shards)

    def count_words(batches):
        keys, counts, held = [], [], 0
        for _, raw, at in shared.chunks(batches):
            k, c = np.unique(tokens(raw, at)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HOLD:
                k, c = _merged(keys, counts)
                keys, counts, held = [k], [c], len(k) // 2
                if len(k) > HOLD:
                    yield _blobs(k, c, bounds)
                    keys, counts, held = [], [], 0
        if keys:
            yield _blobs(*_merged(keys, counts), bounds)

    def write_words(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        k, c = _together(pdf)
        files, top = open_dir(uri)
        put(files, f"{top}/hash-{part:05d}", k.astype("<u8").tobytes())
        kind = _put_counts(files, top, "count", part, c)
        at, share = _marks(c)
        return pd.DataFrame({"part": [part], "n": [len(k)], "total": [int(c.sum())], "count": [kind], "at": [at], "share": [share]})

    counted = shared.materialize(docs.mapInArrow(count_words, _BLOBS).groupBy("part").applyInPandas(write_words, "part int, n long, total long, count string, at array<long>, share array<double>"))
    rows = sorted(counted.collect(), key=lambda r: r["part"])  # a row per shard
    shared.discard(counted)
    parts = {r["part"]: {"n": r["n"], "total": r["total"], "hash": "<u8", "count": r["count"]} for r in rows}
    vocabulary = Vocabulary(uri, parts, shards)
    size, total = int(vocabulary.base[-1]), sum(p["total"] for p in parts.values())
    bits = (size + 1).bit_length()  # the start token's number is size; the highest number stands for unknown words
    points = [(int(vocabulary.base[r["part"]]) + i, x, r["total"] / MARKS) for r in rows for i, x in zip(r["at"], r["share"], strict=True)]
    points += [(size, (i + 1) / MARKS, n_docs / MARKS) for i in range(MARKS)]
    spec = {"uri": uri, "shards": shards, "parts": parts, "size": size, "total": total, "bits": bits, "order": order, "levels": []}
    lowest = size  # the first number of the level below that begins a text
    for m in range(2, order + 1):
        level = {"m": m, "ranges": _ranges(points, shards, bits, size), "parts": {}}
        lowest, points = _count_level(docs, spec, level, lowest)
        spec["levels"].append(level)
    return spec


_META = "part int, n long, blob binary, kind string, counts array<long>, low long, sums array<string>, edge array<long>, at array<long>, share array<double>, total long, starts long"
_BELOW = "part int, kind string, total long, counts array<long>, above long, low long, sums array<string>, edge array<long>"


def _put_figures(files, top: str, m: int, part: int, sums: np.ndarray) -> list[str]:
    """Write the sums of a part's contexts, a file each; their types."""
    return [_put_counts(files, top, f"sum{m}{i}", part, sums[:, i]) for i in range(4)]


def _count_level(docs: DataFrame, spec: dict, level: dict, lowest: int) -> tuple[int, list]:
    """Write the m-grams of all docs and the continuation counts of the level below; fills both levels.

    Returns the first number of the m-grams that begin a text, and points for the next level's ranges.
    """
    uri, parts, shards, bits, size = spec["uri"], spec["parts"], spec["shards"], spec["bits"], spec["size"]
    m, ranges, below, last = level["m"], level["ranges"], list(spec["levels"]), level["m"] == spec["order"]
    mask = np.uint64((1 << bits) - 1)

    def count(batches):
        words, under = Vocabulary(uri, parts, shards), [Grams(uri, x) for x in below]
        keys, counts, held = [], [], 0
        for _, raw, at in shared.chunks(batches):
            t, at = tokens(raw, at)
            number = have = words.of(t)[0]
            for g in under:
                known, k = _keys(_before(have, at, size if g.level["m"] == 2 else -1), number, bits)
                distinct, back = np.unique(k, return_inverse=True)
                have = np.full(len(number), -1, np.int64)
                have[known] = g.places(distinct)[back]
            k, c = np.unique(_keys(_before(have, at, size if m == 2 else -1), number, bits)[1], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HOLD:
                yield _blobs(*_merged(keys, counts), ranges)
                keys, counts, held = [], [], 0
        if keys:
            yield _blobs(*_merged(keys, counts), ranges)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        k, c = _together(pdf)
        files, top = open_dir(uri)
        put(files, f"{top}/key{m}-{part:05d}", k.astype("<u8").tobytes())
        kind = _put_counts(files, top, f"seen{m}", part, c)
        context = (k >> np.uint64(bits)).astype(np.int64)
        row = dict.fromkeys(("blob", "counts", "low", "sums", "edge"))
        if last:
            row["low"], sums, row["edge"] = _figures(context, c)
            row["sums"], row["counts"] = _put_figures(files, top, m, part, sums), _types(c)
        if m == 2:
            ends, to = k & mask, Vocabulary(uri, parts, shards).base
        else:
            g = Grams(uri, below[-1])
            over = g.take("key2", context) & mask if m == 3 else g.take(f"ends{m - 1}", context)
            distinct, back = np.unique((over << np.uint64(bits)) | (k & mask), return_inverse=True)
            ends, to = g.places(distinct)[back].astype(np.uint64), g.base
            if not last:
                put(files, f"{top}/ends{m}-{part:05d}", ends.astype("<u8").tobytes())
        out = _blobs(*np.unique(ends, return_counts=True), to[1:-1].astype(np.uint64)).to_pandas()
        out["kind"] = "ends"
        row["at"], row["share"] = _marks(c)
        meta = pd.DataFrame({x: [v] for x, v in row.items()} | {"part": [part], "n": [len(k)], "kind": [kind], "total": [int(c.sum())], "starts": [int((context >= lowest).sum())]})
        return pd.concat([meta, out.astype(object)], ignore_index=True).reindex(columns=[x.split()[0] for x in _META.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    made = shared.materialize(docs.mapInArrow(count, _BLOBS).groupBy("part").applyInPandas(write, _META))
    rows = sorted(made.filter("kind != 'ends'").drop("blob").collect(), key=lambda r: r["part"])  # a row per shard
    for r in rows:
        level["parts"][r["part"]] = {"n": r["n"], f"key{m}": "<u8", f"seen{m}": r["kind"], f"ends{m}": "<u8"}
    numbers = sum(r["n"] for r in rows)
    if bits + max(1, numbers).bit_length() > 64 and not last:
        raise ValueError(f"{numbers} {m}-grams and {size} words need more than 64 bits")
    if last:
        _close(level, rows)
    under = below[-1] if below else None
    base = Grams(uri, under).base if under else None

    def write_below(pdf: pd.DataFrame) -> pd.DataFrame:
        """Continuation counts of a part of the level below and, from bigrams on, its contexts' figures."""
        part = int(pdf["part"].iloc[0])
        own = (under["parts"] if under else parts).get(part)
        if own is None:
            return pd.DataFrame(columns=[x.split()[0] for x in _BELOW.split(", ")])
        k, c = _together(pdf)
        files, top = open_dir(uri)
        first = int((base if under else Vocabulary(uri, parts, shards).base)[part])
        dense = np.zeros(own["n"], np.int64)
        dense[k.astype(np.int64) - first] = c
        row = {"low": None, "sums": None, "edge": None}
        if under:
            arrays, begin = Arrays(uri, under["parts"]), max(0, lowest - first)
            dense[begin:] = arrays.at(part, f"seen{m - 1}", np.arange(begin, len(dense)))
            row["low"], sums, row["edge"] = _figures((np.asarray(arrays.get(part, f"key{m - 1}")) >> np.uint64(bits)).astype(np.int64), dense)
            row["sums"] = _put_figures(files, top, m - 1, part, sums)
        kind = _put_counts(files, top, f"types{m - 1}", part, dense)
        return pd.DataFrame({x: [v] for x, v in row.items()} | {"part": [part], "kind": [kind], "total": [int(dense.sum())], "counts": [_types(dense)], "above": [int((dense >= 3).sum())]})[[x.split()[0] for x in _BELOW.split(", ")]]

    # a row of every part, as nothing ends in m-grams that begin a text
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("blob"))
    sums = shared.materialize(made.filter("kind = 'ends'").select("part", "n", "blob").unionByName(every).groupBy("part").applyInPandas(write_below, _BELOW))
    done = sorted(sums.collect(), key=lambda r: r["part"])  # a row per shard
    shared.discard(made, sums)
    for r in done:
        (under["parts"] if under else parts)[r["part"]][f"types{m - 1}"] = r["kind"]
    if under:
        _close(under, done)
        _delete(uri, [f"seen{m - 1}{more}-{p:05d}" for p, x in under["parts"].items() for more in ("", "+")[: 1 + x.pop(f"seen{m - 1}").endswith("+")]])
    else:
        low = np.sum([r["counts"] for r in done], axis=0) if done else np.zeros(4)
        types, above = sum(r["total"] for r in done), sum(r["above"] for r in done)
        d = _discounts(low)
        left = (d[0] * low[0] + d[1] * low[1] + d[2] * above) / types if types else 1.0
        spec |= {"low_discounts": d, "types": types, "uniform": left / (size + 1)}
    starts = numbers - sum(r["starts"] for r in rows)
    bases = Grams(uri, level).base
    return starts, [(int(bases[r["part"]]) + i, x, r["total"] / MARKS) for r in rows for i, x in zip(r["at"], r["share"], strict=True)]


def _delete(uri: str, names: list[str]) -> None:
    files, top = open_dir(uri)
    for name in names:
        files.delete_file(f"{top}/{name}")


def _close(level: dict, rows: list) -> None:
    """Enter the figures' places and types, those of contexts at the ends of parts (which may stand in several) and the discounts."""
    m, ends = level["m"], {}
    for r in rows:
        level["parts"][r["part"]] |= {"low": r["low"]} | {f"sum{m}{i}": t for i, t in enumerate(r["sums"])}
        e = np.array(r["edge"]).reshape(2, 5)
        for x in e if e[0, 0] != e[1, 0] else e[:1]:
            ends[int(x[0])] = ends.get(int(x[0]), np.zeros(4, np.int64)) + x[1:]
    level["edges"] = np.array(sorted(ends), np.int64)
    level["edge_sums"] = np.array([ends[x] for x in sorted(ends)], np.int64).reshape(-1, 4)
    level["discounts"] = _discounts(np.sum([r["counts"] for r in rows], axis=0) if rows else np.zeros(4))


class Model:
    """A trained model, its arrays mapped into memory."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.words = Vocabulary(spec["uri"], spec["parts"], spec["shards"])
        self.levels = [Grams(spec["uri"], x) for x in spec["levels"]]
        self.d_low = np.array([0.0, *spec["low_discounts"]])

    def low(self, numbers: np.ndarray) -> np.ndarray:
        """P(w) from continuation counts, of distinct sorted numbers (-1: unknown)."""
        count = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        part = self.words.part_of(numbers[known])
        for p in np.unique(part):
            at = known[part == p]
            count[at] = self.words.arrays.at(int(p), "types1", numbers[at] - self.words.base[p])
        own = np.maximum(count - self.d_low[np.minimum(count, 3)], 0) / max(1, self.spec["types"])
        return own + self.spec["uniform"]

    def high(self, grams: Grams, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, own share, share left for the shorter context) of sorted distinct keys of a level."""
        level, m = grams.level, grams.level["m"]
        number = grams.places(keys)
        context = (keys >> np.uint64(self.spec["bits"])).astype(np.int64)
        seen, sums = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        counts = f"seen{m}" if m == self.spec["order"] else f"types{m}"
        met = np.flatnonzero(number >= 0)
        seen[met] = grams.counts(counts, number[met])
        for p, a, b in grams.spans(keys):
            at = context[a:b] - level["parts"][p]["low"]
            for i in range(4):
                inside = np.flatnonzero((at >= 0) & (at < len(grams.arrays.get(p, f"sum{m}{i}"))))
                sums[a + inside, i] = grams.arrays.at(p, f"sum{m}{i}", at[inside])
        if len(level["edges"]):
            at = np.minimum(np.searchsorted(level["edges"], context), len(level["edges"]) - 1)
            hit = np.flatnonzero(level["edges"][at] == context)
            sums[hit] = level["edge_sums"][at[hit]]
        d = np.array([0.0, *level["discounts"]])
        c, some = np.maximum(sums[:, 0], 1), sums[:, 0] > 0
        own = np.where(some, np.maximum(seen - d[np.minimum(seen, 3)], 0) / c, 0.0)
        return number, own, np.where(some, (sums[:, 1:] * d[1:]).sum(1) / c, 1.0)

    def score(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: n_tokens, n_known, base score, score (log10)."""
        hashes, at = tokens(raw, bounds)
        number, count = self.words.of(hashes)
        distinct, back = np.unique(number, return_inverse=True)
        p, have = self.low(distinct)[back], number
        for g in self.levels:
            known, keys = _keys(_before(have, at, self.spec["size"] if g.level["m"] == 2 else -1), number, self.spec["bits"])
            have = np.full(len(number), -1, np.int64)
            if len(known):
                distinct, back = np.unique(keys, return_inverse=True)
                place, own, left = self.high(g, distinct)
                have[known] = place[back]
                p[known] = own[back] + left[back] * p[known]
        n, v = self.spec["total"], self.spec["size"]
        sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        return np.diff(at), sums((count > 0).astype(np.int64)), sums(np.log10((count + 1) / (n + v + 1))), sums(np.log10(p))


def score(docs: DataFrame, spec: dict) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity (narrow)."""

    def run(batches):
        model = Model(spec)
        for batch, raw, bounds in shared.chunks(batches):
            n, known, base, own = model.score(raw, bounds)
            yield shared.arrow(doc_id=batch.column(0), n_tokens=n, n_known=known, train_tokens=np.full(len(n), spec["total"]), base_score=base, score=own, perplexity=10 ** np.minimum(-own / n, 300.0))

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = shared.text_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held_out = F.coalesce(shared.id_crc() % 7 == 2, F.lit(False))
    out = score(docs, train(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
