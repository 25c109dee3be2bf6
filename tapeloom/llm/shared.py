"""What the corpus operators share: intermediate tables, checked broadcasts, word hashes, blobs.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` so that lost executors
never force a recomputation from text and so that nothing depends on a machine's own disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text hashed at once in a task (one longer document is taken alone).
CHUNK_BYTES = 1 << 20


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset, of a local temporary folder if Spark runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _local[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session (dots written as __) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, *last_read: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, sizes are known.

    Shuffle files go as soon as df is written. The tables ``last_read``, which only df was still to read, are discarded.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for t in last_read:
        discard(t)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_stored_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it counts at most ``rows`` rows of about 100 bytes (df should be materialized), else as it is."""
    wide = [F.octet_length(c) if t in ("string", "binary") else 32 * F.size(c) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    most = F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(df.columns))))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(most, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= 100 * rows else df


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than the default, as rows are whole documents (a setting of one's own stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# --- hashing of words ---------------------------------------------------------------------------

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
POSITION = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw, and the n + 1 offsets of each text's words."""
    inside = ~breaks[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased if fold), and the offsets of each text's words."""
    starts, ends, offsets = word_spans(raw, bounds, breaks)
    return span_hashes(raw, starts, ends, fold), offsets


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes starts..ends of each span (A-Z lower-cased if fold)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[raw] * _power(_MULT, len(raw)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words; a text of fewer words has its whole sequence as one, one without words none."""
    n, size = len(words), np.diff(offsets)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        valid = np.ones(n, bool)
        for j in range(k):
            h[: max(n - j, 0)] += words[j:] * POSITION[j]
            last = offsets[1:] - j
            if j:
                valid[last[(last >= offsets[:-1])]] = False
        for d in np.flatnonzero((size > 0) & (size < k)):
            a, b = offsets[d], offsets[d + 1]
            valid[a] = True
            h[a] = (words[a:b] * POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a) * POSITION[63]
        return mix(h[valid]), np.concatenate(([0], np.cumsum(np.where(size >= k, size - k + 1, np.minimum(size, 1)))))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words starts..ends, in their order."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * _power(_MULT, len(words)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(words) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of sorted batches in which all rows of a value of the first column stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(values == values[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[0].column(held[0].schema.get_field_index(column))[0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose texts have about ``limit`` bytes, with those bytes and their offsets."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        raw, bounds = bytes_of(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin), raw[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
            begin = end
        del raw, bounds, batch
        pa.default_memory_pool().release_unused()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def arrow(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
