"""Frequent phrases by Toivonen's method, ranked as collocations within each language.

A phrase is a run of words of one piece of a text. (1) A sample of the rows proposes phrases: those frequent in it
at a lowered support. (2) A full pass counts, exactly and over all rows, every word and every longer phrase whose
two parts (all words but the last, all but the first) are proposed: these are the proposed phrases and
their negative border, as far as it occurs. (3) Phrases of the border that turn out frequent are failures: an
expansion pass counts the phrases that they make possible, at all lengths at once: a phrase is counted if
each of its parts is known to be frequent or is itself being counted for the first time. A frequent phrase has frequent parts, so
by induction none is missed, and one such pass leaves nothing that a further pass could find.

Sets of phrases go to the workers as Bloom filters (``bloom``): one that is wrongly let through is counted in
vain, none is lost. Counts are rows (hash of language and words, count), added up in each task, then by Spark. A last
pass gives frequent phrases their words and parts. One occurrence of each is enough, so occurrences are chosen by a hash of
their place, the more rarely the more frequent the phrase is: about 6 to 25 of each, however many tasks there are; where
none was chosen, the phrase goes through a second pass that sends all.

Cases: null texts are empty; a null language is ``und``; equal rows count each; phrases are told apart by 64-bit hashes;
an empty table, or one without frequent phrases, gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.llm import bloom, shared

#: Longest phrase; one row of so many is in the sample; share of the support that is asked for there, and the least.
LONGEST = 5
SAMPLE = 16
LOWERED = 0.6
LEAST = 2
#: Phrases held in a task before their counts are sent.
HOLD = 4_000_000
COUNTS = "h long, level int, n long"
NAMES = "h long, prefix long, suffix long, lang string, phrase string"

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(10, 14)]] = True
BREAK = PIECE.copy()
BREAK[[32, 9]] = True


def prepared(docs: DataFrame) -> DataFrame:
    """text, language and its hash, a hash of the row."""
    shared.short_batches(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.xxhash64("doc_id", "lang").alias("row_hash"))


class Runs:
    """The phrases of some texts: ``hashes[n][i]`` and ``there[n][i]`` of the n words from word i."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lang_hash: np.ndarray):
        self.starts, self.ends, self.offsets = shared.word_spans(raw, bounds, BREAK)
        n = len(self.starts)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.offsets))
        words = shared.span_hashes(raw, self.starts, self.ends)
        piece = np.concatenate(([0], np.cumsum(PIECE[raw])))[self.starts] + self.text
        with np.errstate(over="ignore"):
            words = shared.mix(words ^ shared.mix(lang_hash.view(np.uint64)[self.text]))
            self.hashes, self.there = [None, words], [None, np.ones(n, bool)]
            so_far = words * shared.POSITION[0]
            for m in range(2, LONGEST + 1):
                k = max(n - m + 1, 0)
                so_far = so_far[:k] + words[m - 1 :] * shared.POSITION[m - 1]
                self.hashes.append(shared.mix(so_far))
                self.there.append(piece[m - 1 :] == piece[:k])

    def counted(self, proposed: bloom.Filters) -> list:
        """Masks, by length, of the phrases that a full pass counts: all words, and phrases whose parts are proposed."""
        masks, inside = [None, self.there[1]], None
        for m in range(2, LONGEST + 1):
            inside = self._within(masks[m - 1], m - 1, proposed)
            k = len(self.there[m])
            masks.append(self.there[m] & inside[:k] & inside[1 : k + 1])
        return masks

    def opened(self, before: list, proposed: bloom.Filters) -> list:
        """Masks of phrases not counted ``before`` whose parts are proposed or opened themselves."""
        masks = [None, np.zeros(len(self.there[1]), bool)]
        for m in range(2, LONGEST + 1):
            known = self._within(before[m - 1], m - 1, proposed) | masks[m - 1]
            k = len(self.there[m])
            masks.append(self.there[m] & known[:k] & known[1 : k + 1] & ~before[m])
        return masks

    def _within(self, mask: np.ndarray, m: int, proposed: bloom.Filters) -> np.ndarray:
        out = mask.copy()
        out[mask] = proposed.contains(self.hashes[m][mask], "once")
        return out


def _runs(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Runs]]:
    for batch, raw, bounds in shared.chunks(batches):
        yield batch, raw, Runs(raw, bounds, batch.column(2).to_numpy())


def count(rows: DataFrame, chosen, with_words: bool) -> DataFrame:
    """(h, level, n) of the phrases that chosen(runs) masks, by length; level 0 holds each language's words if with_words."""

    def sent(held: list[list[np.ndarray]]):
        for m in range(LONGEST + 1):
            if held[m]:
                h, n = np.unique(np.concatenate(held[m]), return_counts=True)
                yield shared.arrow(h=shared.signed(h), level=np.full(len(h), m, np.int32), n=n.astype(np.int64))

    def run(batches):
        held, size = [[] for _ in range(LONGEST + 1)], 0
        for batch, _, runs in _runs(batches):
            if with_words:
                held[0].append(batch.column(2).to_numpy().view(np.uint64)[runs.text])
            masks = chosen(runs)
            for m in range(1, LONGEST + 1):
                if masks[m].any():
                    held[m].append(runs.hashes[m][masks[m]])
                    size += len(held[m][-1])
            if size >= HOLD:
                yield from sent(held)
                held, size = [[] for _ in range(LONGEST + 1)], 0
        yield from sent(held)

    return rows.mapInArrow(run, COUNTS).groupBy("h", "level").agg(F.sum("n").alias("n"))


def _filter(phrases: DataFrame, group: Column | None = None) -> bloom.Filters:
    """A filter of the hashes h of a stored table, mixed with a number of their group."""
    segments = bloom.segments_for(phrases.count())

    def run(batches):
        for batch in batches:
            h = np.unique(_grouped(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            yield from bloom.partial(h, np.zeros(len(h), bool), segments)

    rows = phrases.select("h", (F.lit(0) if group is None else group).cast("long").alias("group"))
    return bloom.build(rows.mapInArrow(run, bloom.PARTIAL), segments, shared.shared_dir(phrases.sparkSession))


def _grouped(h: np.ndarray, group) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h + np.asarray(group).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def frequent(docs: DataFrame, support: int = 100, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, int]:
    """All phrases (h, level, n) of at least ``support`` occurrences, words included; words of each language (h, n); expansion passes made."""
    rows = prepared(docs)
    lowered = max(LEAST, int(support / sample * LOWERED))
    few = rows.filter(F.pmod(F.xxhash64("row_hash", "text"), F.lit(sample)) == 0)
    proposed = shared.materialize(count(few, lambda runs: runs.there, False).filter(F.col("n") >= lowered).select("h"))
    first = _filter(proposed)
    counted = shared.materialize(count(rows, lambda runs: runs.counted(first), True).filter((F.col("n") >= support) | (F.col("level") == 0)))
    totals, known = counted.filter("level = 0").select("h", "n"), counted.filter("level > 0")
    failures = known.filter(F.col("level") < LONGEST).join(proposed, "h", "left_anti")
    if failures.isEmpty():
        return known, totals, 0
    now = _filter(known)
    # a phrase opened here is counted together with all that its being frequent would make possible: no failure is left after this pass
    more = shared.materialize(count(rows, lambda runs: runs.opened(runs.counted(first), now), False).filter(F.col("n") >= support))
    return known.unionByName(more), totals, 1


def named(docs: DataFrame, phrases: DataFrame, support: int) -> DataFrame:
    """phrases (h, level, n) of two words or more with lang, phrase (words joined by spaces) and the hashes of their two parts.

    Phrases are grouped by powers of 4 of n / support; group g sends one occurrence in support / 6 * 4**g."""
    rows = prepared(docs)
    group = F.floor(F.log(F.col("n") / support) / F.log(F.lit(4.0)))
    todo, out = phrases.filter("level > 1"), None
    most = todo.agg(F.max(group)).first()[0] or 0
    for chosen in ([max(1, support // 6) * 4**g for g in range(most + 1)], [1]):
        wanted = _filter(todo, group if len(chosen) > 1 else None)

        def run(batches, wanted=wanted, chosen=chosen):
            sent = np.zeros(0, np.uint64)
            for batch, raw, runs in _runs(batches):
                data, langs = raw.tobytes(), batch.column(1)
                with np.errstate(over="ignore"):
                    place = shared.mix(batch.column(3).to_numpy().view(np.uint64)[runs.text] + (np.arange(len(runs.text)) - runs.offsets[:-1][runs.text]).astype(np.uint64))
                for m in range(2, LONGEST + 1):
                    h, at = runs.hashes[m], np.flatnonzero(runs.there[m])
                    dice, found = shared.mix(h ^ place[: len(h)]), []
                    for g, every in enumerate(chosen):
                        at = at[dice[at] % np.uint64(every) == 0]
                        found.append(at[wanted.contains(_grouped(h[at], g), "once")])
                    at = np.concatenate(found)
                    distinct, where = np.unique(h[at], return_index=True)
                    new = ~np.isin(distinct, sent, assume_unique=True)
                    sent = np.concatenate((sent, distinct[new]))[-HOLD:]  # one sent twice is sent in vain
                    at = at[where[new]]
                    starts, ends = [runs.starts[at + j].tolist() for j in range(m)], [runs.ends[at + j].tolist() for j in range(m)]
                    words = [b" ".join(data[a[i] : b[i]] for a, b in zip(starts, ends, strict=True)).lower().decode() for i in range(len(at))]
                    yield shared.arrow(
                        h=shared.signed(h[at]), prefix=shared.signed(runs.hashes[m - 1][at]), suffix=shared.signed(runs.hashes[m - 1][at + 1]),
                        lang=langs.take(pa.array(runs.text[at])), phrase=pa.array(words, pa.string()),
                    )

        names = rows.mapInArrow(run, NAMES).groupBy("h").agg(*(F.first(c).alias(c) for c in ("prefix", "suffix", "lang", "phrase")))
        found = shared.materialize(todo.join(names, "h"))
        out = found if out is None else out.unionByName(found)
        todo = todo.join(found.select("h"), "h", "left_anti")
        if todo.isEmpty():
            break
    return out


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of a occurrences is cut after its first k words into parts of l and r occurrences, and scores floor(1000 a n / (l r)) of its
    lowest-scoring cut (ties: least k), n the language's words. Phrases inside a longer one with as many occurrences are left out.
    """
    counts, totals, _ = frequent(docs, support, sample)
    phrases = named(docs, counts, support)
    every = counts.select("h", "n").join(phrases.select("h", "prefix", "suffix"), "h", "left")
    every = shared.small(shared.materialize(every))
    cuts = phrases.withColumns({"_p": F.col("prefix"), "_s": F.col("suffix")})
    for j in range(1, LONGEST):  # parts of all words but the last j, or the first j
        for side, way in (("_p", "prefix"), ("_s", "suffix")):
            step = every.select(F.col("h").alias(side), F.col("n").alias(f"{side}{j}"), F.col(way).alias("_next"))
            cuts = cuts.join(step, side, "left").drop(side).withColumnRenamed("_next", side)
    cuts = cuts.withColumn("h_lang", F.xxhash64("lang")).join(shared.small(totals.select(F.col("h").alias("h_lang"), F.col("n").alias("words"))), "h_lang")
    options = []
    for m in range(2, LONGEST + 1):
        for k in range(1, m):
            one = F.expr(f"(cast(1000 as decimal(38,0)) * n * words) div (cast(_p{m - k} as decimal(38,0)) * _s{k})")
            options.append(F.when(F.col("level") == m, F.struct(one.alias("score"), F.lit(k).alias("k"), F.col(f"_p{m - k}").alias("l"), F.col(f"_s{k}").alias("r"))))
    longer = phrases.filter("level > 2").select("n", F.explode(F.array("prefix", "suffix")).alias("h")).groupBy("h").agg(F.max("n").alias("_longer"))
    scored = cuts.withColumn("cut", F.array_min(F.array(*options))).join(longer, "h", "left").filter("_longer is null or 100 * _longer < 100 * n")
    scored = scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("words").alias("n"), "cut.score", F.pmod("h", F.lit(64)).alias("_salt"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("_i", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*best))).filter(F.col("_i") <= top)  # a language's phrases are ranked in 64 parts first
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.col("rank").cast("long"))


SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
nl AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT c.lang, c.phrase, c.m, c.a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM c, range(1, 5) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, nl.n, ((1000::HUGEINT * k.a * nl.n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp JOIN nl ON nl.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, array_to_string(ws[2:], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(ws[1:m - 1], ' '), a FROM c),
d AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM g GROUP BY 1, 2) x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000"""
