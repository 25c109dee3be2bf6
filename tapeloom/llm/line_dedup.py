"""Lines that many documents hold, kept in one of them alone.

A line's key is the line stripped of white space ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Pass 1 puts the
hashes of all keys of at least ``least_chars`` code points into two Bloom filters, of those seen in
any document and of those seen in two or more (``bloom``). In pass 2 only keys of the second
filter, the suspected repeats, leave their task, as 128-bit digests with their document; Spark
counts each digest's different documents exactly and chooses the one that keeps it (that of greatest id, or of
least). Pass 3 drops the lines from the others. All lines of a chosen document stay, repeated ones too.

Cases: null and empty texts are one empty line; rows with the same doc_id are one document (a null
id is the least one of all); a text that loses all lines is empty; other columns are left out, whatever their
names; an empty table gives no rows. Texts of any length are hashed whole, one at a time if they are long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import bloom, shared
from tapeloom.llm.token_files import NULL_ID

#: Hashes held in a task before they go to the filters.
HOLD = 2_000_000


def lines(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the n + 1 offsets of each text's lines (an empty text has one)."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate((bounds[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((bounds[1:], breaks)))
    return starts, ends, np.searchsorted(breaks, bounds) + np.arange(len(bounds))


def keys(raw: np.ndarray, bounds: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a key long enough: the key's start and end, the line's number, the text's number."""
    starts, ends, offsets = lines(raw, bounds)
    solid = ~shared.SPACE[raw]
    upto, at = np.concatenate(([0], np.cumsum(solid))), np.flatnonzero(solid)
    some = np.flatnonzero(upto[ends] > upto[starts])
    first, last = at[upto[starts[some]]], at[upto[ends[some]] - 1] + 1
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    long = points[last] - points[first] >= least_chars
    some = some[long]
    return first[long], last[long], some, np.searchsorted(offsets, some, "right") - 1


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [hashlib.blake2b(data[a:b].lower(), digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]  # lower() of bytes: A-Z alone


def _once_a_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first line of each (text, hash)."""
    order = np.lexsort((hashes, text))
    new = np.concatenate(([True], (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))) if len(order) else np.zeros(0, bool)
    return order[new]


def filters(docs: DataFrame, least_chars: int) -> bloom.Filters:
    """Pass 1, over doc_id and text."""
    points, n_lines = F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    most = docs.agg(F.sum(F.least(n_lines, F.floor((points + 1) / (least_chars + 1))))).first()[0]  # no text can have more long lines
    segments = bloom.segments_for(int(most or 0))

    def run(batches):
        held, n = [], 0

        def sent():
            distinct, many = np.unique(np.concatenate(held), return_counts=True)
            return bloom.partial(distinct, many > 1, segments)

        for _, raw, bounds in shared.chunks(batches):
            starts, ends, _, text = keys(raw, bounds, least_chars)
            h = shared.span_hashes(raw, starts, ends)
            held.append(h[_once_a_text(text, h)])
            n += len(held[-1])
            if n >= HOLD:
                yield from sent()
                held, n = [], 0
        if held:
            yield from sent()

    return bloom.build(docs.mapInArrow(run, bloom.PARTIAL), segments, shared.shared_dir(docs.sparkSession))


def suspects(docs: DataFrame, seen: bloom.Filters, least_chars: int) -> DataFrame:
    """Pass 2: (key, doc) of the keys that the filter of repeated ones holds, once a text."""

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            starts, ends, _, text = keys(raw, bounds, least_chars)
            h = shared.span_hashes(raw, starts, ends)
            some = _once_a_text(text, h)
            some = some[seen.contains(h[some], "twice")]
            ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy()
            yield shared.arrow(key=pa.array(_digests(raw, starts[some], ends[some]), pa.binary()), doc=ids[text[some]])

    return shared.materialize(docs.mapInArrow(run, "key binary, doc long"))


def repeated(found: DataFrame, least_docs: int, keep: str = "last") -> DataFrame:
    """(key, n_docs, keeper) of the keys of at least least_docs different documents.

    A hot key's documents are counted apart: first (key, doc) pairs once each, then partial counts a key.
    """
    pairs = found.select("key", "doc").distinct()
    chosen = F.max("doc") if keep == "last" else F.min("doc")
    return pairs.groupBy("key").agg(F.count("*").alias("n_docs"), chosen.alias("keeper")).filter(F.col("n_docs") >= least_docs)


def drop_repeated(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, keep: str = "last") -> DataFrame:
    """doc_id, text (without the lines that another document keeps), n_lines (before), n_dropped."""
    texts = shared.text_of(docs)
    found = suspects(texts, filters(texts, least_chars), least_chars)
    common = shared.materialize(repeated(found, least_docs, keep))
    lost = found.join(shared.small(common), "key").filter(F.col("doc") != F.col("keeper"))
    lost = shared.materialize(lost.groupBy("doc").agg(F.collect_set("key").alias("lost")), found, common)
    both = texts.withColumn("doc", F.coalesce("doc_id", F.lit(int(NULL_ID)))).join(shared.small(lost), "doc", "left")

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            starts, ends, offsets = lines(raw, bounds)
            n_dropped, out = np.zeros(batch.num_rows, np.int64), batch.column(1)
            gone = np.zeros(len(starts), bool)
            lists = batch.column(2)
            if lists.null_count < len(lists):
                first, last, line, text = keys(raw, bounds, least_chars)
                have = np.asarray(lists.is_valid())
                some = np.flatnonzero(have[text])
                sets = {i: set(lists[i].as_py()) for i in np.flatnonzero(have).tolist()}
                hit = [d in sets[t] for d, t in zip(_digests(raw, first[some], last[some]), text[some].tolist(), strict=True)]
                gone[line[some[np.array(hit, bool)]]] = True
                n_dropped = np.add.reduceat(gone, offsets[:-1], dtype=np.int64)
                data = raw.tobytes()
                new = out.to_pylist()
                for i in np.flatnonzero(n_dropped).tolist():
                    stay = np.flatnonzero(~gone[offsets[i] : offsets[i + 1]]) + offsets[i]
                    new[i] = b"\n".join(data[starts[j] : ends[j]] for j in stay.tolist()).decode()
                out = pa.array(new, pa.string())
            yield shared.arrow(doc_id=batch.column(0), text=out, n_lines=np.diff(offsets), n_dropped=n_dropped)

    return both.select("doc_id", "text", "lost").mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def query(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT l.doc_id, l.line, l.i, k.keeper IS NOT NULL AND k.keeper <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""
