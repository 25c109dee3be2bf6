"""Benchmark decontamination.

Items go in blocks of at most ``BLOCK`` to all tasks; documents are read once per block. Frequencies are
counted over all items, so blocks only split the work. In a
document, item-sized word windows are taken where one of an item's rarest shingles stands, those that make up more than a
quarter of its weight (a window without any of them is below the similarity; shingles that many items share, like a
common opening, are looked up for no item), laid by all of the item's shingles near by, and fingerprinted by weighted SimHash. A multi-index over the items'
fingerprints, by item size, finds all within ``RADIUS`` bits: of 8 blocks of 8 bits one differs in at
most RADIUS // 8 places, so items are filed under all such neighbours of each block. Candidates are
verified by exact weighted-shingle similarity: the sum of least over greatest weights,
a shingle's weight being its count times its inverse frequency among the items.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; shingles have five words; an item of fewer words
is one shingle. Cases: null and empty texts have no windows; items without words match nothing;
repeated items and documents are reported each, null ids as null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.encode import gather
from tapeloom.llm.token_files import NULL_ID

K = 5
SIMILARITY = 0.75
RADIUS = 23
BLOCK = 20_000
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of weighted hashes (no run is empty)."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a in range(0, len(out), 2048):
        b = min(len(out), a + 2048)
        at = slice(offsets[a], offsets[b])
        bits = np.unpackbits(hashes[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat((bits * 2.0 - 1.0) * weights[at, None], offsets[a:b] - offsets[a], axis=0)
        out[a:b] = ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)
    return out


def _near(radius: int) -> np.ndarray:
    """All 8-bit masks of at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(8), n)])


def build_index(item_ids: list[int], texts: list[str], total: int | None = None, held_by: dict[int, int] | None = None) -> dict:
    """The index of one block; total and held_by: the count of all items, and of those with a shingle where more blocks than this one are."""
    raw, bounds = shared.bytes_of(pa.array(texts, pa.string()))
    words, at = shared.word_hashes(raw, bounds)
    hashes, to = shared.shingles(words, at, K)
    size, count = np.diff(at), np.diff(to)
    item = np.repeat(np.arange(len(size)), count)
    keys, inverse = np.unique(hashes, return_inverse=True)
    pairs, n_pairs = np.unique(np.stack((inverse, item)), axis=1, return_counts=True)
    own = np.bincount(pairs[0], minlength=len(keys))
    total = len(size) if total is None else total
    idf = np.log1p(total / np.maximum(own if held_by is None else np.array([held_by[k] for k in shared.signed(keys).tolist()], np.int64), 1))
    order = np.argsort(inverse, kind="stable")
    offset = np.arange(len(hashes)) - np.repeat(to[:-1], count)
    rare = _rarest(pairs, n_pairs * idf[pairs[0]], len(size))[np.searchsorted(pairs[0] * len(size) + pairs[1], inverse * len(size) + item)]
    first = order[rare[order]]
    some = np.flatnonzero(count)
    prints = np.zeros(len(size), np.uint64)
    prints[some] = fingerprints(hashes, idf[inverse], np.append(to[:-1][some], len(hashes)))
    sizes = np.unique(size[some])
    files = []
    for b in range(8):
        value = ((prints[some] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
        key = (np.searchsorted(sizes, size[some])[:, None] * 256 + (value[:, None] ^ _near(RADIUS // 8)[None, :])).ravel()
        who = np.repeat(some, len(_near(RADIUS // 8)))
        o = np.argsort(key, kind="stable")
        files.append((np.searchsorted(key[o], np.arange(len(sizes) * 256 + 1)), who[o]))
    flags = np.zeros(1 << 20, bool)
    flags[(keys >> np.uint64(44)).astype(np.int64)] = True
    return {
        "ids": np.array(item_ids, np.int64), "size": size, "keys": keys, "idf": idf, "unseen": float(np.log1p(total)), "flags": flags,
        "pair": inverse[order] * len(size) + item[order], "pair_offset": offset[order],
        "post": np.searchsorted(inverse[first], np.arange(len(keys) + 1)), "post_item": item[first], "post_offset": offset[first],
        "prints": prints, "sizes": sizes, "files": files, "to": to, "shingle": inverse, "short": [n for n in range(1, K) if n in set(size.tolist())],
    }


def _rarest(pairs: np.ndarray, weight: np.ndarray, items: int) -> np.ndarray:
    """Which (shingle, item) pairs are the item's rarest, up to more than 1 - SIMILARITY of its weight: a window without any of them is below SIMILARITY."""
    share = np.bincount(pairs[1], weight, items)
    each = np.bincount(pairs[1], minlength=items)
    with np.errstate(invalid="ignore"):
        alone = weight / np.bincount(pairs[0])[pairs[0]]
    order = np.lexsort((pairs[0], -alone, pairs[1]))
    sums = np.cumsum(weight[order])
    begun = np.concatenate(([0.0], sums))[np.cumsum(each) - each]
    before = sums - weight[order] - begun[pairs[1][order]]
    out = np.zeros(len(weight), bool)
    out[order] = before <= (1 - SIMILARITY) * share[pairs[1][order]] + 1e-9
    return out


def _anchors(ix: dict, words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and key numbers of the items' k-word shingles in the texts."""
    h, to = shared.shingles(words, at, K) if k == K else _short(words, at, k)
    near = np.flatnonzero(ix["flags"][(h >> np.uint64(44)).astype(np.int64)])
    key = np.searchsorted(ix["keys"], h[near])
    ok = ix["keys"][np.minimum(key, len(ix["keys"]) - 1)] == h[near]
    near, key = near[ok], key[ok]
    text = np.searchsorted(to, near, "right") - 1
    return at[:-1][text] + near - to[text], key


def _short(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-word windows, hashed like a text of just these k < K words."""
    size = np.maximum(np.diff(at) - k + 1, 0)
    start = gather(at[:-1], size)
    runs = words[(start[:, None] + np.arange(k)).ravel()]
    return shared.shingles(runs, np.arange(len(start) + 1) * k, K)[0], np.concatenate(([0], np.cumsum(size)))


def find(ix: dict, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Verified (text, item, first word, words, similarity), the best window of each text and item."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
    if not len(ix["keys"]):
        return none
    words, at = shared.word_hashes(raw, bounds)
    pairs = [_anchors(ix, words, at, k) for k in (K, *ix["short"])]
    pos, key = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(pos):
        return none
    order = np.argsort(pos, kind="stable")
    pos, key = pos[order], key[order]
    many = ix["post"][key + 1] - ix["post"][key]
    p = gather(ix["post"][key], many)
    item, text = ix["post_item"][p], np.searchsorted(at, np.repeat(pos, many), "right") - 1
    size = ix["size"][item]
    # where an item may stand, in steps of its size; windows there are laid by all of its shingles
    spot = np.unique(np.stack((text, item, (np.repeat(pos, many) - ix["post_offset"][p]) // size), 1), axis=0)
    text, item, size = spot[:, 0], spot[:, 1], ix["size"][spot[:, 1]]
    low, high = np.searchsorted(pos, np.maximum(at[text], (spot[:, 2] - 1) * size)), np.searchsorted(pos, np.minimum(at[text + 1], (spot[:, 2] + 3) * size))
    many = np.maximum(high - low, 0)
    near, item = gather(low, many), np.repeat(item, many)
    wanted = key[near] * len(ix["size"]) + item
    low = np.searchsorted(ix["pair"], wanted)
    many = np.searchsorted(ix["pair"], wanted, "right") - low
    pos, item = np.repeat(pos[near], many), np.repeat(item, many)
    size, text = ix["size"][item], np.searchsorted(at, pos, "right") - 1
    start = np.clip(pos - ix["pair_offset"][gather(low, many)], at[text], np.maximum(at[text], at[text + 1] - size))
    wins = np.unique(np.stack((start, size, text), 1), axis=0)
    start, size, text = wins[:, 0], wins[:, 1], wins[:, 2]
    runs = np.minimum(size, at[text + 1] - start)
    h, to = shared.shingles(words[gather(start, runs)], np.concatenate(([0], np.cumsum(runs))), K)
    key = np.minimum(np.searchsorted(ix["keys"], h), len(ix["keys"]) - 1)
    seen = ix["keys"][key] == h
    weight = np.where(seen, ix["idf"][key], ix["unseen"])
    prints = fingerprints(h, weight, to)
    group = np.searchsorted(ix["sizes"], size) * 256
    found = []
    for b, (starts, who) in enumerate(ix["files"]):
        k = group + ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
        n = starts[k + 1] - starts[k]
        found.append(np.repeat(np.arange(len(k)), n) * len(ix["ids"]) + who[gather(starts[k], n)])
    pair = np.unique(np.concatenate(found))
    win, item = pair // len(ix["ids"]), pair % len(ix["ids"])
    close = np.bitwise_count(prints[win] ^ ix["prints"][item]) <= RADIUS
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for w, i in zip(win[close].tolist(), item[close].tolist(), strict=True):
        mine, n_mine = np.unique(np.where(seen[to[w] : to[w + 1]], key[to[w] : to[w + 1]], -1 - np.arange(to[w + 1] - to[w])), return_counts=True)
        theirs, n_theirs = np.unique(ix["shingle"][ix["to"][i] : ix["to"][i + 1]], return_counts=True)
        _, x, y = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        least = (np.minimum(n_mine[x], n_theirs[y]) * ix["idf"][theirs[y]]).sum()
        both = weight[to[w] : to[w + 1]].sum() + (n_theirs * ix["idf"][theirs]).sum() - least
        sim = float(least / both) if both else 0.0
        if sim >= SIMILARITY - 1e-12:
            k = (int(text[w]), i)
            best[k] = max(best.get(k, (0.0, 0, 0)), (sim, -int(start[w] - at[text[w]]), int(runs[w])))
    if not best:
        return none
    t, i = np.array(sorted(best), np.int64).T
    s = [best[k] for k in sorted(best)]
    return t, i, np.array([-x[1] for x in s], np.int64), np.array([x[2] for x in s], np.int64), np.array([x[0] for x in s])


def frequencies(items: DataFrame) -> DataFrame:
    """Rows (block, key, df): for each block the shingles of its items with the number of all items that have them."""

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            h, to = shared.shingles(*shared.word_hashes(raw, bounds), K)
            pairs = np.unique(np.stack((np.repeat(np.arange(batch.num_rows), np.diff(to)).astype(np.uint64), h), 1), axis=0)
            yield shared.arrow(block=batch.column(0).take(pa.array(pairs[:, 0].astype(np.int64))), key=shared.signed(np.ascontiguousarray(pairs[:, 1])))

    held = items.select("block", "text").mapInArrow(run, "block long, key long").groupBy("block", "key").count()
    held = shared.materialize(held)
    return shared.materialize(held.join(held.groupBy("key").agg(F.sum("count").alias("df")), "key").select("block", "key", "df"))


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of blocks of at most BLOCK items, in order of (item_id, text)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    build = lambda rows, *of: spark.sparkContext.broadcast(build_index([r[0] if r[0] is not None else int(NULL_ID) for r in rows], [r[1] for r in rows], *of))
    if items.limit(BLOCK + 1).count() <= BLOCK:
        return [build(items.orderBy("item_id", "text").collect())]
    shared.short_batches(spark)
    numbered = items.orderBy("item_id", "text").rdd.zipWithIndex().map(lambda r: (r[1] // BLOCK, r[0][0], r[0][1]))
    items = shared.materialize(spark.createDataFrame(numbered, "block long, item_id long, text string"))
    total, held, out = items.count(), frequencies(items), []
    for b in range(-(-total // BLOCK)):
        held_by = {r[0]: r[1] for r in held.filter(F.col("block") == b).select("key", "df").collect()}
        rows = items.filter(F.col("block") == b).orderBy("item_id", "text").select("item_id", "text").collect()
        out.append(build(rows, total, held_by))
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found: doc_id, item_id, first_word, n_words, similarity."""
    slim, parts = shared.text_of(docs), []
    for index in indexes(benchmark):

        def run(batches, index=index):
            ix = index.value
            for batch, raw, bounds in shared.chunks(batches):
                t, i, start, n, s = find(ix, raw, bounds)
                yield shared.arrow(doc_id=batch.column(0).take(t), item_id=pa.array(ix["ids"][i], mask=ix["ids"][i] == NULL_ID), first_word=start, n_words=n, similarity=s)

        parts.append(slim.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contaminated(text: Column, index) -> Column:
    """True for texts that hold an item of the index."""

    def run(texts: pa.Array) -> pa.Array:
        flags = []
        for batch, raw, bounds in shared.chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
            own = np.zeros(batch.num_rows, bool)
            own[find(index.value, raw, bounds)[0]] = True
            flags.append(own)
        return pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))

    return F.arrow_udf(run, "boolean")(F.coalesce(text.cast("string"), F.lit("")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with docs' own columns (narrow)."""
    out = docs
    for index in indexes(benchmark):
        out = out.filter(~contaminated(F.col("text"), index))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
