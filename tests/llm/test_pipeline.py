"""The corpus pipeline against a plain version of all five stages, and the cases of token files, packing and decontamination."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm import classifier, decontaminate, language_model, packing, shared, token_files
from tapeloom.llm.encode import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[\x20\x09-\x0d]"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
GAMMA, PRIOR, FENCE = 1.02, 50, 2.0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def split(text):
    return re.findall(f"[^{SPACE[1:]}+", text or "")


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 4 else [tuple(words)] if words else []


def folded(text):
    return split((text or "").translate(LOWER))


# --- a plain version of each stage ----------------------------------------------------------------


def plain_measures(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
    threes = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n, chars = len(words), sum(map(len, words))
    values = {
        "mean_word": chars / max(n, 1), "symbol_ratio": sum(c in "#*$%&|<>" for c in text or "") / max(n, 1),
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_ratio": len(repeated) / max(n, 1),
    }
    return n < 50 or 100 * len(repeated) > 50 * n, values


def plain_quality(rows):
    """Rows within the fences, for the four measures that the fixture's texts differ in."""
    own = {id(r): plain_measures(r[1]) for r in rows}

    def quantiles(k, keep):
        bins = sorted(math.ceil(math.log(own[id(r)][1][k]) / math.log(GAMMA) - 1e-9) for r in rows if not own[id(r)][0] and keep(r) and own[id(r)][1][k] > 0)
        return (len(bins), [GAMMA ** bins[max(0, math.ceil(q * len(bins) - 1e-9) - 1)] for q in (0.01, 0.05, 0.5, 0.95, 0.99)]) if bins else None

    out = []
    for r in rows:
        failed, values = own[id(r)]
        ok = not failed
        for k, v in values.items() if ok else ():
            levels = [quantiles(k, keep) for keep in (lambda x: True, lambda x: x[2] == r[2], lambda x: x[2:4] == r[2:4])]
            if not levels[0]:
                continue
            q = levels[0][1]
            for level in filter(None, levels[1:]):
                q = [(level[0] * a + PRIOR * b) / (level[0] + PRIOR) for a, b in zip(level[1], q, strict=True)]
            ok = ok and v <= max(q[2] + FENCE * (q[3] - q[2]), q[4]) * (1 + 1e-9)
            ok = ok and (k != "mean_word" or v >= min(q[2] - FENCE * (q[2] - q[1]), q[0]) / GAMMA * (1 - 1e-9))
        if ok:
            out.append(r)
    return out


def plain_near(rows):
    sets = [set(grams(folded(r[1]))) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if least[find(i)] == r[0]]


def plain_passages(rows):
    """Without words of passages of a lesser id: of 50 words at least on both sides, five equal ones at both ends, similarity 0.75, at one shift."""
    gone = collections.defaultdict(set)
    words = {r[0]: folded(r[1]) for r in rows}
    places = {i: {g: j for j, g in enumerate(grams(w))} for i, w in words.items()}
    for a in sorted(words):
        for b in (b for b in words if b > a):
            common = places[a].keys() & places[b].keys()
            for shift in {places[b][g] - places[a][g] for g in common}:
                x = sorted(places[b][g] for g in common if places[b][g] - places[a][g] == shift)
                for i, s in enumerate(x):
                    for e in x[i:]:
                        mine, theirs = set(grams(words[b][s : e + 5])), set(grams(words[a][s - shift : e + 5 - shift]))
                        if e + 5 - s >= 50 and len(mine & theirs) >= 0.75 * len(mine | theirs):
                            gone[b].update(range(s, e + 5))
    out = []
    for r in rows:
        if r[0] not in gone:
            out.append(r)
            continue
        parts = re.findall(f"[^{SPACE[1:]}+{SPACE}*", r[1])
        lead = r[1][: len(r[1]) - sum(map(len, parts))]
        text = lead + "".join(p for i, p in enumerate(parts) if i not in gone[r[0]])
        out.append((*r[:1], text, *r[2:4], len(text)))
    return out


def plain_clean(rows, items):
    held = [collections.Counter(grams(folded(t))) for _, t in items]
    many = collections.Counter(g for c in held for g in c)
    weight = lambda g: math.log1p(len(items) / max(many[g], 1))

    def hit(text):
        words = folded(text)
        for own, (_, item) in zip(held, items, strict=True):
            n = len(folded(item))
            for a in range(len(words) - n + 1) if n else ():
                mine = collections.Counter(grams(words[a : a + n]))
                both = sum(min(c, mine[g]) * weight(g) for g, c in own.items())
                if both and both >= (0.75 - 1e-9) * (sum(c * weight(g) for g, c in (*mine.items(), *own.items())) - both):
                    return True
        return False

    return [r for r in rows if not hit(r[1])]


def plain_pieces(rows, path, end_id, capacity):
    out = []
    for r in rows:
        ids = np.array([*encoder(path).tokenizer.encode(r[1] or "", add_special_tokens=False).ids, end_id], "<u4")
        first = (len(ids) - 1) % capacity + 1
        for piece, at in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[at : at + (capacity if piece else first)]
            out.append((r[0], piece, at, len(part), zlib.crc32(part.tobytes())))
    return out


def assert_packed(out, capacity):
    """Sequences without gaps or overlaps, about as few as plain best fit needs."""
    per = collections.defaultdict(list)
    for r in out:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in per.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [p for p, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    free = []
    for n in sorted((r["length"] for r in out), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    assert len(per) <= len(free) * 1.05 + 2


# --- the pipeline -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus():
    """110 documents: plain ones, short and repetitive ones, odd symbols, copies, near copies, common passages, benchmark items."""
    rng = random.Random(71)
    texts = [prose(rng, rng.randint(70, 140)) for _ in range(90)]
    items = [(i, prose(rng, rng.randint(10, 30))) for i in range(6)] + [(6, None), (None, "")]
    texts += [prose(rng, 8), "", None, " \n ", "no no no no " * 30, " ".join(w if i % 2 else "% # |" for i, w in enumerate(texts[3].split()))]
    texts += ["\n".join(prose(rng, 12) for _ in range(6)) + "\n" + "\n".join(["the very same line"] * 8)]
    texts += [texts[4], texts[4].upper(), texts[5].replace(" ", "\n", 5), " ".join("zz" if i == 50 else w for i, w in enumerate(texts[6].split()))]
    passage, edited = prose(rng, 64), prose(rng, 70).split()
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}", f"  {prose(rng, 90)}\n{passage}  \n {prose(rng, 20)}", f"{passage} {prose(rng, 90)}"]
    texts += [f"{prose(rng, 60)} {' '.join(edited)} {prose(rng, 30)}", f"{prose(rng, 70)} {' '.join('zz' if i == 33 else w for i, w in enumerate(edited))} {prose(rng, 40)}"]
    texts += [f"{prose(rng, 60)} {items[0][1]} {prose(rng, 20)}", f"{prose(rng, 60)} {items[1][1].upper()}", f"{prose(rng, 60)} {' '.join(items[2][1].split()[:5])} {prose(rng, 20)}"]
    texts += [prose(rng, 1500)]
    rows = [(3 * i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows, items


def test_pipeline_against_a_plain_version(spark, corpus, tmp_path):
    import public_tokenizers

    rows, items = corpus
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = rows
    plain = [plain_quality, plain_near, plain_passages, lambda x: plain_clean(x, items)]
    got = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), step in zip(corpus_pipeline.STAGES, plain, strict=False):
        before, want = want, step(want)
        got = shared.materialize(stage(spark, got, str(tmp_path)))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), name
        assert want != before, name
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(plain_pieces(want, path, 0, 2048))
    assert max(r["piece"] for r in out) > 0
    assert_packed(out, 2048)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# --- cases ------------------------------------------------------------------------------------------

ODD = "doc_id long, text string, piece int, start string, length long, rank int, base long, score string, part int"


def odd_rows(*rows):
    """Rows with further columns whose names clash with those of the operators."""
    return [(i, t, 7, "x", -1, 3, None, "y", 0) for i, t in rows]


def test_packing_of_repeated_rows_null_ids_ties_and_clashing_names(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    same = prose(rng, 9)
    rows = odd_rows((1, "a b"), (1, "a b"), (1, "c"), (None, "d e"), (None, None), (2, ""), (3, prose(rng, 400)), *((10 + i, same) for i in range(40)))
    out = packing.pack_documents(spark.createDataFrame(rows, ODD).repartition(5), capacity=64).collect()
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=key) == sorted(plain_pieces(rows, path, 0, 64), key=key)
    assert_packed(out, 64)


def test_token_files_of_nothing_repeated_rows_and_null_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = odd_rows((5, "a b"), (5, "a b"), (5, "c d e"), (None, "x"), (None, None), (2, "long " * 4000), (9, ""))
    df, uri = spark.createDataFrame(rows, ODD).repartition(4), shared.shared_dir(spark)
    out = token_files.read(token_files.write(df, path, 1, uri), uri).collect()
    ids = lambda t: np.array([*encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    want = sorted(((r[0] if r[0] is not None else -1), len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    out.sort(key=lambda r: r["start"])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
    assert [r["doc_id"] for r in out] == [None, None, 2, 5, 5, 5, 9]
    uri = shared.shared_dir(spark)
    assert token_files.read(token_files.write(df.limit(0), path, 1, uri), uri).count() == 0


def test_decontamination_of_nothing_repeated_rows_null_ids_and_a_very_long_text(spark):
    rng = random.Random(6)
    item = prose(rng, 12)
    held = f"{prose(rng, 20000)} {item.upper()} {prose(rng, 20000)}"
    rows = odd_rows((1, held), (1, held), (None, item), (2, prose(rng, 30)), (3, None), (4, ""))
    df = spark.createDataFrame(rows, ODD)
    bench = spark.createDataFrame([(None, item, "q"), (-1, item, "q"), (8, None, "q"), (9, "", "q")], "item_id long, text string, similarity string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect())
    assert got == {(1, None): 2, (1, -1): 2, (None, None): 1, (None, -1): 1}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.keep_clean(df, bench.limit(0)).count() == 6
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.keep_clean(df.limit(0), bench).count() == 0


def test_scores_with_clashing_names_repeated_rows_and_nothing(spark):
    rows = odd_rows(*((i, f"{'good fine' if i % 2 else 'bad poor'} words {i % 7}") for i in range(40)), (1, "good fine words 1"), (None, None))
    df = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(40)] + [(1, 1, "z"), (None, 1, "z")], "doc_id long, quality int, score string")
    out = classifier.score(df, classifier.train(df, labels)).collect()
    assert len(out) == 42 and all(0 <= r["score"] <= 1 for r in out) and all((r["score"] > 0.3) == bool(r["doc_id"] % 2) for r in out if r["doc_id"] is not None)
    assert classifier.score(df.limit(0), classifier.train(df.limit(0), labels)).count() == 0
    slim = shared.text_of(df)
    assert language_model.score(slim, language_model.train(slim, 8)).count() == 42
