"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted; each partition writes ``<n>.ids`` (flat
little-endian unsigned ids of the tokenizer's narrowest type) and ``<n>.idx`` (int64 doc ids, then
int64 offsets, one more than documents), under a temporary name that is moved into place, so a task
run again replaces its own file by an equal one. A partition's base in the whole sequence is the
prefix sum of the partitions' counts. Readers map the files into memory.

Cases: null texts are empty documents (only the end id); rows with the same doc_id stand together
in order of their text's hash, null ids come first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.encode import encoder

NULL_ID = np.iinfo(np.int64).min


def open_dir(uri: str) -> tuple[pafs.FileSystem, str]:
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)
    return files, path


def put(files: pafs.FileSystem, path: str, *parts: bytes) -> None:
    """Write parts as one file that appears whole or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
    files.move(temporary, path)


def mapped(files: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """A file's numbers: mapped into memory where the folder is a local path, else read."""
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if files.get_file_info(path).size else np.zeros(0, dtype)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write(docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> DataFrame:
    """Write the files below uri; one row per file: part, n_docs, n_ids, dtype, base (ids before it)."""

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        files, top = open_dir(uri)
        ids_at, temporary = f"{top}/{part:06d}", uuid.uuid4().hex
        doc_ids, lengths, out = [], [], None
        for batch, raw, bounds in shared.chunks(batches):
            ids, offsets = enc.encode(raw, bounds)
            ids = np.insert(ids, offsets[1:], end_id)
            out = out or files.open_output_stream(f"{ids_at}.{temporary}.tmp")
            out.write(ids.astype(enc.dtype, copy=False).tobytes())
            doc_ids.append(batch.column(0).fill_null(int(NULL_ID)).to_numpy())
            lengths.append(np.diff(offsets) + 1)
        if out is None:
            return
        out.close()
        docs_, offsets = np.concatenate(doc_ids), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype("<i8")
        with files.open_output_stream(f"{ids_at}.{temporary}.idx.tmp") as idx:
            idx.write(docs_.astype("<i8").tobytes())
            idx.write(offsets.tobytes())
        files.move(f"{ids_at}.{temporary}.tmp", f"{ids_at}.ids")
        files.move(f"{ids_at}.{temporary}.idx.tmp", f"{ids_at}.idx")
        yield shared.arrow(part=np.array([part], np.int64), n_docs=np.array([len(docs_)], np.int64), n_ids=np.array([offsets[-1]], np.int64), dtype=pa.array([enc.dtype.str]))

    ordered = shared.text_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = shared.materialize(ordered.mapInArrow(run, "part long, n_docs long, n_ids long, dtype string"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(parts: DataFrame, uri: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""

    def run(batches):
        files, top = open_dir(uri)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{top}/{row['part']:06d}"
                idx, ids = mapped(files, f"{at}.idx", "<i8"), mapped(files, f"{at}.ids", row["dtype"])
                n = row["n_docs"]
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    docs, offsets = np.array(idx[a:b]), np.array(idx[n + a : n + b + 1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                    yield shared.arrow(doc_id=pa.array(docs, mask=docs == NULL_ID), start=row["base"] + offsets[:-1], n_tokens=np.diff(offsets), ids_crc32=np.array(crc, np.int64))

    n = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return parts.repartition(int(n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = shared.shared_dir(spark)
    parts = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1, uri)
    return read(parts, uri)
