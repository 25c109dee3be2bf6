"""Bloom filters of 64-bit hashes, built in Spark: one of hashes seen, one of those seen twice or more.

A filter is cut into segments of 2**20 bits; a hash has three bits in one segment. Tasks send the bits
of what they have seen, segment by segment and compressed; a reducer folds a segment's partial
filters one after another: a bit is seen twice if a partial filter says so, or two partial filters have it. So
the second filter holds every hash seen twice, and few others. Segments are files in the shared
folder, which workers load when they first need them; there are at most ``MOST`` of them (128 MB a
filter). More hashes than that make a filter let more through and lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm import shared
from tapeloom.llm.token_files import mapped, open_dir, put

#: Bits of a segment (a power of two), bits of a filter for each hash, segments at most.
SEGMENT_BITS = 20
BITS_PER_HASH = 16
MOST = 1 << 10
PARTIAL = "segment long, once binary, twice binary"
_BYTES = 1 << (SEGMENT_BITS - 3)


def segments_for(hashes: int) -> int:
    """Number of segments for so many hashes: a power of two."""
    wanted = max(1, -(-hashes * BITS_PER_HASH >> SEGMENT_BITS))
    return min(MOST, 1 << (wanted - 1).bit_length())


def _bits(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Places of the three bits of each hash in the whole filter, one row a bit."""
    h = shared.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    base = (hashes & np.uint64(segments - 1)) << np.uint64(SEGMENT_BITS)
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    return np.stack([base | ((h >> np.uint64(s)) & low) for s in (0, 20, 40)])


def _packed(places: np.ndarray) -> bytes:
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    bits[places.astype(np.int64)] = True
    return pa.compress(np.packbits(bits, bitorder="little").tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=_BYTES, codec="zstd", asbytes=True), np.uint8)


def partial(hashes: np.ndarray, twice: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTIAL`` for distinct hashes; twice marks those that this task has seen more than once."""
    if not len(hashes):
        return
    places, many = np.unique(np.concatenate((_bits(hashes, segments).ravel(), _bits(hashes[twice], segments).ravel())), return_counts=True)
    segment = (places >> np.uint64(SEGMENT_BITS)).astype(np.int64)
    inside = places & np.uint64((1 << SEGMENT_BITS) - 1)
    cuts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        here = inside[a:b]
        yield pa.RecordBatch.from_arrays([pa.array([segment[a]], pa.int64()), pa.array([_packed(here)], pa.binary()), pa.array([_packed(here[many[a:b] > 1])], pa.binary())], ["segment", "once", "twice"])


def build(partials: DataFrame, segments: int, uri: str) -> Filters:
    """Fold rows of ``PARTIAL`` into the filters' files below uri."""
    spark = partials.sparkSession

    def fold(batches):
        files, top = open_dir(uri)
        now, once, twice = None, None, None

        def done():
            put(files, f"{top}/once-{now:05d}", once.tobytes())
            put(files, f"{top}/twice-{now:05d}", twice.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], ["segment"])

        for batch in batches:
            for segment, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, once, twice = segment, np.zeros(_BYTES, np.uint8), np.zeros(_BYTES, np.uint8)
                more = _unpacked(o)
                twice |= _unpacked(t) | (once & more)
                once |= more
        if now is not None:
            yield done()

    parts = min(segments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = partials.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(fold, "segment long")
    return Filters(uri, segments, sorted(r[0] for r in shared.materialize(made).collect()))  # at most MOST rows


class Filters:
    """Both filters; workers load a segment's file when they first meet it."""

    def __init__(self, uri: str, segments: int, there: list[int]):
        self.uri, self.segments, self.there = uri, segments, there
        self._loaded: dict[str, tuple] = {}

    def __getstate__(self):
        return {"uri": self.uri, "segments": self.segments, "there": self.there, "_loaded": {}}

    def contains(self, hashes: np.ndarray, kind: str = "twice") -> np.ndarray:
        """Which hashes a filter (once or twice) holds, among them a few that it was not given."""
        if not len(hashes):
            return np.zeros(0, bool)
        if kind not in self._loaded:
            missing = np.zeros(self.segments, bool)
            missing[self.there] = True
            self._loaded[kind] = (np.zeros(self.segments * _BYTES, np.uint8), missing, open_dir(self.uri))
        bits, missing, (files, top) = self._loaded[kind]
        wanted = np.zeros(self.segments, bool)
        wanted[(hashes & np.uint64(self.segments - 1)).astype(np.int64)] = True
        for s in np.flatnonzero(wanted & missing).tolist():
            bits[s * _BYTES : (s + 1) * _BYTES] = mapped(files, f"{top}/{kind}-{s:05d}", np.uint8)
            missing[s] = False
        found = np.ones(len(hashes), bool)
        for place in _bits(hashes, self.segments):
            found &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found
