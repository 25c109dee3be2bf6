"""Best-fit packing with large-item matching.

Only documents longer than a sequence are cut, into full pieces behind a shorter first one. Pieces
are packed by their lengths alone: the number of pieces of each length (at most ``capacity`` numbers,
whatever the input) decides a plan. Pieces above one third of the capacity are matched greedily,
each with the largest other one that fits, at most two in a bin; smaller pieces, longest first, go
where they fit best. The plan says how many bins of each pattern there are; each piece finds
its bin from its rank among pieces of its length, which Spark computes by hashed buckets and prefix
sums, so no length and no bin is gathered in a task.

Cases: null and empty texts are documents of the end id alone; repeated rows are packed each; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.encode import encoder

CAPACITY = 2048
BUCKETS = 256


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (narrow)."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch, raw, bounds in shared.chunks(batches):
            ids, offsets = enc.encode(raw, bounds)
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            count = -(-n // capacity)
            first = n - (count - 1) * capacity
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            at = offsets[doc] + start
            crc = [zlib.crc32(ids[a : a + m].astype("<u4").tobytes()) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield shared.arrow(doc_id=batch.column(0).take(doc), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=np.array(crc, np.int64))

    return shared.text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in the bin) for so many pieces of each length."""
    left = {k: v for k, v in counts.items() if v}
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by free room
    large = sorted(k for k in left if k > capacity // 3)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else 0
        n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
        if a == b and not n:  # a single one is left; the next smaller may go with it
            b = large[at - 1] if at > 0 else 0
            n = 1
        bins[capacity - a - b][(a, b) if b else (a,)] += n
        for k in (a, b):
            if k:
                left[k] -= n
        large = [k for k in large if left[k]]
    rooms = sorted(bins)
    for size in sorted((k for k in left if k <= capacity // 3 and left[k]), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // size
            if at == len(rooms):  # new bins
                made = [((), -(-n // each))]
            else:
                made = sorted(bins.pop(room).items())
                rooms.pop(at)
            for pattern, many in made:
                full = min(many, n // each)
                rest = n - full * each if full < many else 0
                rest = min(rest, each)
                for take, of in ((each, full), (rest, 1 if rest else 0), (0, many - full - (1 if rest else 0))):
                    if of and (pattern or take):
                        free = room - take * size
                        if free not in bins or not bins[free]:
                            if free not in rooms:
                                insort(rooms, free)
                        bins[free][pattern + (size,) * take] += of
                        n -= take * of
    return [(n, pattern) for room in sorted(bins) for pattern, n in sorted(bins[room].items()) if n]


def place_table(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, bins, first sequence, offset), by rank: which piece of that length goes where."""
    rows, given, base = defaultdict(list), defaultdict(int), 0
    for n, pattern in bins:
        offset = 0
        for size in pattern:
            rows[size].append((given[size], n, base, offset))
            given[size] += n
            offset += size
        base += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (of ``pieces``, materialized) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = place_table(plan(counts, capacity))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    sums = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.materialize(sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("rank", F.row_number().over(own) - 1).join(shared.small(bases), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows, at = table[int(k)], np.flatnonzero(length == k)
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 2] + rank[at] - row[:, 0], row[:, 3]
            yield shared.arrow(**{c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packing of all docs; tokenizer: a file of the tokenizers library."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(shared.materialize(pieces(docs, tokenizer, end_id, capacity)), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
