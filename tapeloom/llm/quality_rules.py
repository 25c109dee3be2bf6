"""Quality rules with adaptive thresholds.

Per document, measures of its whole text; per (lang, source), a mergeable quantile sketch of each
measure (log-spaced bins with counts, as in DDSketch: merging is addition, so it is exact about
merging, independent of order and recomputable); from the sketches, fences that replace fixed
cutoffs. Sketches are of the texts that pass the base rule; fences are taken from those that have a trait at all, as most have no repeated line or
symbol: a fence stands ``FENCE`` times as far from their median as the 95th percentile, and never within
the 99th (so at most one in a hundred of the texts with a trait falls by it). No constant is added to what the sketches say. A group's quantiles are
drawn towards those of its language, and these towards all texts', with the weight of ``PRIOR`` texts,
at every size alike. Documents beyond a fence, or failing the base rule, are rejected.

Cases: null or empty texts have no words and fail the base rule; null lang or source is a group of
its own; a measure that no text has sets no fence; repeated rows are judged alike; extra columns are
kept by ``keep_good``; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm import shared

#: Relative width of a sketch's bins.
GAMMA = 1.02
#: The fence's distance from the median in distances of the 95th percentile (3.3 standard deviations for normal measures at 2).
FENCE = 2.0
#: Texts of the wider group that a group's quantiles are mixed with.
PRIOR = 50
#: measure -> whether it has a fence below, too.
MEASURES = {"mean_word": True, "symbol_ratio": False, "dup_line_ratio": False, "repeat_ratio": False, "upper_ratio": False, "mark_ratio": False}
_SHARES = {"b01": 0.01, "b05": 0.05, "b50": 0.5, "b95": 0.95, "b99": 0.99}
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))


def _counts(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    starts, ends, offsets = shared.word_spans(raw, bounds)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])

    n = np.diff(offsets)
    chars = per_text(((raw & 0xC0) != 0x80) & ~shared.SPACE[raw])
    words, _ = shared.word_hashes(raw, bounds, fold=False)
    windows, at = shared.shingles(words, offsets, 3)
    text = np.repeat(np.arange(len(n)), np.diff(at))
    with np.errstate(over="ignore"):
        key = shared.mix(windows + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice & (n[text] >= 3)) if len(key) else np.zeros(0, np.int64)
    covered = np.zeros(len(words) + 2, bool)
    first = hit - at[text[hit]] + offsets[text[hit]]
    for j in range(3):
        covered[first + j] = True
    repeats = np.diff(np.concatenate(([0], np.cumsum(covered[: len(words)], dtype=np.int64)))[offsets])
    data = raw.tobytes()
    lines, dups = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for d in range(len(n)):
        own = [x for x in data[bounds[d] : bounds[d + 1]].split(b"\n") if x.strip()]
        lines[d], dups[d] = len(own), len(own) - len(set(own))
    upper = per_text((raw >= 65) & (raw <= 90))
    return [n.astype(np.int64), chars, per_text(_SYMBOL[raw]), dups, repeats, lines, upper, per_text(_MARK[raw])]


def _measures(text: pa.Array) -> pa.Array:
    parts = []
    for _, raw, bounds in shared.chunks([pa.RecordBatch.from_arrays([text], ["text"])]):
        parts.append(np.stack(_counts(raw, bounds), 1))
    counts = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(NAMES))], NAMES)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, lang and source, and the counts of each whole text as struct ``m`` (narrow)."""
    shared.short_batches(docs.sparkSession)
    own = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(*keep, *own, F.arrow_udf(_measures, _TYPE).asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m"))


def ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("m.n_words"), F.lit(1)), F.greatest(F.col("m.n_lines"), F.lit(1))
    chars = F.greatest(F.col("m.word_chars"), F.lit(1))
    return {
        "mean_word": F.col("m.word_chars") / words,
        "symbol_ratio": F.col("m.n_symbols") / words,
        "dup_line_ratio": F.col("m.n_dup_lines") / lines,
        "repeat_ratio": F.col("m.n_repeat_words") / words,
        "upper_ratio": F.col("m.n_upper") / chars,
        "mark_ratio": F.col("m.n_marks") / words,
    }


def base_failed() -> Column:
    return (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, measure, bin, n): texts in bin have a measure of at most GAMMA**bin and more than GAMMA**(bin - 1).

    A row with no measure stands for each group, also where no text has any trait."""
    traits = [F.struct(F.lit(k).alias("measure"), v.cast("double").alias("v")) for k, v in ratios().items()]
    stacked = measured.filter(~base_failed()).select("lang", "source", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("measure"), F.lit(1.0).alias("v")), *traits)).alias("x"))
    stacked = stacked.filter("x.v > 0").select("lang", "source", "x.measure", F.ceil(F.log("x.v") / math.log(GAMMA) - 1e-9).cast("int").alias("bin"))
    return stacked.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def quantiles(own: DataFrame, *by: str) -> DataFrame:
    """Per group: key (of ``by`` and measure), rows and the quantiles (upper ends of their bins); the sketches of wider groups are sums of bins."""
    merged = own.filter("measure is not null").groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    at = merged.withColumns({"upto": upto, "rows": F.sum("n").over(group)})
    first = (F.min(F.when(F.col("upto") >= q * F.col("rows"), F.pow(F.lit(GAMMA), F.col("bin")))).alias(b) for b, q in _SHARES.items())
    out = at.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), *first)
    return out.select(_key(*by), F.struct("rows", *_SHARES).alias("_".join(("q", *by))))


def _key(*by: str) -> Column:
    return F.to_json(F.struct(*by, "measure"), {"ignoreNullFields": "false"}).alias("_".join(("key", *by)))


def thresholds(own: DataFrame, fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """One row per (lang, source): fences, a struct of the low and high fence of each measure (null: none)."""
    levels = [("lang", "source"), ("lang",), ()]
    rows = own.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
    rows = rows.select("*", *(_key(*by) for by in levels))
    for by in levels:
        rows = rows.join(quantiles(own, *by), "_".join(("key", *by)), "left")
    b = {}
    for name in _SHARES:
        mixed = F.col("q")[name]
        for q in (F.col("q_lang"), F.col("q_lang_source")):
            mixed = F.coalesce((q["rows"] * q[name] + prior * mixed) / (q["rows"] + prior), mixed)
        b[name] = mixed
    high = F.greatest(b["b50"] + fence * (b["b95"] - b["b50"]), b["b99"]) * (1 + 1e-9)
    low = F.least(b["b50"] - fence * (b["b50"] - b["b05"]), b["b01"]) / (GAMMA * (1 + 1e-9))
    found = rows.select("lang", "source", "measure", F.when(F.col("measure").isin([k for k, both in MEASURES.items() if both]), low).alias("low"), high.alias("high"))
    wide = found.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{side}_{k}") for k in MEASURES for side in ("low", "high")))
    return wide.select("lang", "source", F.struct(*(f"{side}_{k}" for k in MEASURES for side in ("low", "high"))).alias("fences"))


def verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed and kept; limits must be materialized (joined by broadcast if it is small)."""
    limits = shared.small(limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fences"), 50_000)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for k, v in ratios().items():
        within = within & F.coalesce(v >= F.col(f"fences.low_{k}"), F.lit(True)) & F.coalesce(v <= F.col(f"fences.high_{k}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("_lang", "_source", "fences")


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source, the counts m, base_failed and kept."""
    measured = shared.materialize(measure(docs, "doc_id"))
    return verdict(measured, shared.materialize(thresholds(shared.materialize(sketches(measured)))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with docs' own columns. Texts are read twice rather than shuffled."""
    limits = shared.materialize(thresholds(shared.materialize(sketches(measure(docs)))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "lang", "source", "text")
    return verdict(measure(rows, "_row"), limits).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", *(f"m.{n}" for n in NAMES[:5]), "base_failed", "kept", "lang", "source")
