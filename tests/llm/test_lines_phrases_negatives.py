"""Line deduplication, phrase collocations and hard negatives against plain versions, and their special cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import bloom, collocations, hard_negatives, line_dedup, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Documents (id, text, language) with the other columns of the table, and two whose names clash with the operators' own."""
    full = [(i, t, lang, "web", 0, 7, "x") for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS + ", n_lines long, key string").repartition(3)


# --- Bloom filters --------------------------------------------------------------------------------


def test_filters_hold_all_that_was_seen_and_few_others(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 2**63, 5_000, dtype=np.uint64)
    parts = [np.concatenate((once[:10_000], twice)), np.concatenate((once[10_000:], twice[:2_500])), twice[2_500:]]
    segments = bloom.segments_for(25_000)
    rows = spark.createDataFrame([(h.tobytes(),) for h in parts], "blob binary").repartition(3)

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                h = np.frombuffer(blob, np.uint64)
                yield from bloom.partial(np.unique(h), np.zeros(len(h), bool), segments)

    made = bloom.build(rows.mapInArrow(run, bloom.PARTIAL), segments, shared.shared_dir(spark))
    assert made.contains(np.concatenate((once, twice)), "once").all() and made.contains(twice, "twice").all()
    strangers = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    assert made.contains(strangers, "once").mean() < 0.05 and made.contains(once, "twice").mean() < 0.05


def test_a_hash_seen_twice_in_one_task_is_seen_twice(spark):
    h = np.array([11, 22, 33], np.uint64)
    rows = spark.range(1)

    def run(batches):
        for _ in batches:
            yield from bloom.partial(h, np.array([True, False, False]), 1)

    made = bloom.build(rows.mapInArrow(run, bloom.PARTIAL), 1, shared.shared_dir(spark))
    assert made.contains(h, "twice").tolist() == [True, False, False]


# --- lines ----------------------------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, least_chars, least_docs, keep=max):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    keeper = {k: keep(d) for k, d in holders.items() if len(d) >= least_docs}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if keeper.get(key(x), i) == i]
        out.append((i, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out)


def test_lines_against_a_plain_version(spark):
    r = random.Random(3)
    common = [f"{w} " * 4 + "ÄÖ é" for w in ("Alpha Beta", "gamma delta", "Überall nichts", "kurz")]
    rows = []
    for i in range(120):
        parts = [r.choice(["", " ", "\t" + r.choice(common) + "  \r", r.choice(common).upper(), f"own line of document {i} " * 2, "\x0b" + r.choice(common)]) for _ in range(r.randrange(8))]
        rows.append((i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n" + common[0])]
    got = line_dedup.drop_repeated(docs_of(spark, [(i, t, "en") for i, t in rows]), 20, 5)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == plain_lines(rows, 20, 5)
    first = line_dedup.drop_repeated(docs_of(spark, [(i, t, "en") for i, t in rows]), 20, 5, keep="first")
    assert sorted(map(tuple, first.collect())) == plain_lines(rows, 20, 5, min)


def test_lines_of_repeated_rows_null_ids_and_long_texts(spark):
    line = "a line that is long enough to be one of the repeated ones"
    long = "\n".join(f"line number {i} of a very long text that repeats itself nowhere" for i in range(40_000)) + "\n" + line
    rows = [(1, line), (1, line), (1, "other\n" + line), (2, line), (3, line), (None, line), (9, long)]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated(docs_of(spark, [(i, t, "en") for i, t in rows]), 40, 5).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (None, 1, 1), (9, 40_001, 0)}
    few = [(1, line), (1, line), (1, line), (2, line), (3, line), (4, line)]  # four documents
    assert line_dedup.drop_repeated(docs_of(spark, [(i, t, "en") for i, t in few]), 40, 5).filter("n_dropped > 0").isEmpty()
    assert line_dedup.drop_repeated(docs_of(spark, []).limit(0)).isEmpty()


def test_only_suspected_lines_leave_their_task(spark):
    line = "this line stands in many documents and is a suspected repeat"
    rows = [(i, f"{line}\nthis line belongs to document number {i} and to no other one", "en") for i in range(300)]
    texts = shared.text_of(docs_of(spark, rows))
    found = line_dedup.suspects(texts, line_dedup.filters(texts, 40), 40)
    assert found.filter(F.col("key") == hashlib.blake2b(line.encode(), digest_size=16).digest()).count() == 300
    assert found.count() < 330


# --- phrases --------------------------------------------------------------------------------------


def plain_phrases(rows, support, top):
    counts, words = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for m in range(1, 6):
                counts[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in counts.items():
        f = {g: a for g, a in c.items() if a >= support}
        inside = Counter()
        for g, a in f.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], a)
        scored = []
        for g, a in f.items():
            if len(g) > 1 and 100 * inside[g] < 100 * a:
                score, _, left, right = min((1000 * a * words[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (s, a, g, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrase_rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["École", "UPPER", "ñ"]
    fixed = ["new york city", "once upon a time there", "as soon as possible", "École de la vie"]
    rows = []
    for i in range(400):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randrange(25))]
        text = "".join(p + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts)
        rows.append((i, text, r.choice(["en", "en", "en", "fr", None])))
    return rows + [(900, None, "en"), (901, "", None), (902, " .,;", "de"), (None, "new york city", "en"), (903, "x " * 300, "en"), (903, "x " * 300, "en")]


@pytest.mark.parametrize("sample", [1, 4, 400])
def test_phrases_against_a_plain_version(spark, sample):
    rows = phrase_rows()
    got = collocations.collocations(docs_of(spark, rows), support=12, top=40, sample=sample)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 12, 40)


def test_failures_of_the_border_are_made_good(spark):
    """A sample that proposes next to nothing: the expansion pass finds all the rest, phrases of five words among it."""
    rows = phrase_rows()
    known, _, passes = collocations.frequent(docs_of(spark, rows), support=12, sample=400)
    assert passes == 1 and known.filter("level = 5").count() > 0
    whole, _, _ = collocations.frequent(docs_of(spark, rows), support=12, sample=1)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, whole.collect()))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, []).limit(0)).isEmpty()
    assert collocations.collocations(docs_of(spark, [(1, "a b", "en")])).isEmpty()


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([(10**9, 10**13, 10**9, 10**10)], "a long, n long, l long, r long")
    got = phrases.selectExpr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as s").first()["s"]
    assert got == 1000 * 10**9 * 10**13 // (10**9 * 10**10)


# --- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, every, k, low, high, scale=256):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        if all(abs(x) <= 2**27 for x in ints) and (i not in kept or (label, ints) < kept[i]):
            kept[i] = (label, ints)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = [(-dot(v, w), i, other) for i, (other, w) in kept.items() if i != a]
        for s, p, _ in sorted(x for x in scores if x[2] == label)[:k]:
            band = sorted(x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize(("d", "low"), [(64, 80), (7, 20), (130, 50)])
def test_negatives_against_a_plain_version(spark, d, low):
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((6, d)) / np.sqrt(d)
    rows = [(int(i), int(rng.integers(3)), (centres[rng.integers(6)] + rng.standard_normal(d) * 0.4 / np.sqrt(d)).astype(np.float32).tolist()) for i in range(500)]
    rows[40:60] = [(i, i % 3, rows[0][2]) for i in range(40, 60)]  # ties
    rows += [(None, 1, rows[1][2]), (700, None, rows[1][2]), (710, 1, None), (720, 1, [None] * d), (730, 1, [float("nan")] * d), (740, 1, [float("inf")] * d), (750, 1, [3e38] * d)]
    rows += [(760, 1, []), (770, 1, [0.0] * d), (780, 2, rows[2][2][: d // 2]), (20, 1, rows[3][2]), (20, 0, rows[4][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, norm string").repartition(3)
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, 4, 4, low, 100)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10, 4, low, 100)


def test_intervals_hold_and_narrow(spark):
    rng = np.random.default_rng(2)
    d = 64
    v = np.floor(256 * rng.standard_normal((3000, d)) / 8)
    v[0] = 0
    table = spark.createDataFrame([(i, 0, x.astype(int).tolist()) for i, x in enumerate(v)], "vec_id long, label int, ints array<long>")
    rows, _ = hard_negatives.coded(table)
    slab = hard_negatives.Codes(rows.toArrow(), d)
    q = v[:50]
    low, high = slab.intervals(q)
    exact = q @ slab.ints.T
    assert (low <= exact).all() and (exact <= high).all()
    assert slab.alignment[slab.ids > 0].min() > 0.8
    free = np.linalg.norm(q, axis=1)[1:, None] * slab.norm[None, :]  # what lengths alone say
    assert np.median((high - low)[1:] / (2 * np.maximum(free, 1))) < 0.45


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).isEmpty()
    one = spark.createDataFrame([(10, 1, [0.5]), (11, 2, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(one, F.col("vec_id") % 10 == 0).isEmpty()
