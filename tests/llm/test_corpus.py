"""Corpus operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import classifier, components, decontaminate, jaccard_join, language_model, license_scan, packing, quality_rules, shared, substring_dedup, token_files, url_filter
from tapeloom.llm.encode import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\n", 3), " ".join(w if i % 40 else "x" for i, w in enumerate(texts[2].split()))]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage + " " + prose(rng, 70), prose(rng, 3), "ab  cd", "", None, " \n ", "é ü " * 3, ("wörd " * 3000).strip()]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_word_and_shingle_hashes_tell_words_apart(rows):
    texts = [r[1] or "" for r in rows]
    raw, bounds = shared.bytes_of(pa.array(texts))
    h, at = shared.word_hashes(raw, bounds)
    names = {}
    for d, t in enumerate(texts):
        mine = words(t)
        assert at[d + 1] - at[d] == len(mine)
        for w, x in zip(mine, h[at[d] : at[d + 1]].tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_license_templates_and_base_phrases(spark):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "under the terms of the mit license", "mit license", None, "", "cc by nc cc by nc"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [got[i]["labels"] for i in range(9)] == ["mit", "apache-2", "cc-by-nc", "gpl", "mit", "", "", "", "cc-by-nc"]
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (2, 0, 3) and got[6]["n_words"] == 0 and got[5]["score"] < 1


def test_quality_counts_against_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = got[i]["m"]
        assert (m["n_words"], m["word_chars"], m["n_repeat_words"], m["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    made = [(i, prose(rng, 80) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 80).split()), int(i % 3 > 0)) for i in range(300)] + [(900, None, 1), (901, "", None)]
    df = spark.createDataFrame(made, "doc_id long, text string, quality int")
    out = {r["doc_id"]: r for r in classifier.score(df, classifier.train(df, df)).collect()}
    assert all(out[i]["predicted"] == q for i, _, q in made[:300] if out[i]["held_out"]) and 0 <= out[900]["score"] <= 1
    assert classifier.train(df.limit(0), df)["slope"] == 0.0


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_against_brute_force(spark, rows):
    rng = random.Random(9)
    base = prose(rng, 100).split()
    near = [(1000 + k, " ".join("q" if rng.random() < 0.02 * (k % 4) else w for w in base), "en", "s", 0) for k in range(40)]
    df = spark.createDataFrame([*rows, *near], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()}
    assert got == brute_components([*rows, *near])
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, c in got.values()})
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(30)] + [(7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(30))


def test_passages_are_found_and_cut(docs, rows):
    found = {(r["of_doc_id"], r["doc_id"]): r for r in substring_dedup.repeats(docs).collect()}
    assert (44, 45) in found and found[44, 45]["first_word"] == 0 and found[44, 45]["n_words"] >= 60
    assert all({a, b} <= {0, 1, 2, 40, 41, 42, 43, 44, 45} for a, b in found)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs).collect()}
    assert len(words(cut[45])) == 70 and words(cut[41]) == [] and cut[5] == rows[5][1] and cut[49] is None


def test_edited_passages_are_found(spark):
    rng = random.Random(6)
    made, want = [], set()

    def add(passage):
        made.append((len(made), f"{prose(rng, 70)} {passage} {prose(rng, 70)}"))
        return len(made) - 1

    for k in range(30):
        w = prose(rng, 74 if k % 3 == 2 else 60).split()
        edits = {0: w[:30] + ["new"] + w[30:], 1: w[:30] + ["two", "words"] + w[32:], 2: [x if i not in (24, 49) else "n" for i, x in enumerate(w)]}
        want.add((add(" ".join(w)), add(" ".join(edits[k % 3]))))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["of_doc_id"], r["doc_id"]): r for r in substring_dedup.repeats(df).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want)  # a min-hash in common: 1 - 0.25 ** 4 at least
    for a, b in got:
        x, y = (words(made[i][1]) for i in (a, b))
        r = got[a, b]
        y = y[r["first_word"] : r["first_word"] + r["n_words"]]
        best = max(len(p & q) / len(p | q) for n in range(len(y) - 2, len(y) + 3) for p, q in [[{tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (x[r["of_first_word"] : r["of_first_word"] + n], y)]])
        assert len(y) >= 50 and best >= r["similarity"] >= 0.75


def test_passages_that_the_first_document_only_quotes(spark):
    rng = random.Random(7)
    passage = prose(rng, 80).split()
    made = [(1, " ".join([prose(rng, 60), *passage[20:65], prose(rng, 60)]))] + [(i, " ".join([prose(rng, 60), *passage, prose(rng, 60)])) for i in range(2, 6)]
    twice = prose(rng, 60).split()
    made += [(10, " ".join([*twice[:30], prose(rng, 60), *twice])), (11, " ".join([prose(rng, 60), *twice]))]
    df = spark.createDataFrame([(i, t if i > 1 else t.replace(passage[42], "other")) for i, t in made], "doc_id long, text string")
    got = {(r["of_doc_id"], r["doc_id"]): r["n_words"] for r in substring_dedup.repeats(df).collect()}
    assert {(2, 3), (2, 4), (2, 5), (10, 11)} <= set(got) and got[2, 5] == 80 and got[10, 11] == 60


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.concatenate(([0], np.cumsum(rng.integers(0, 50, 5))))
        h, width = rng.integers(0, 2**63, at[-1], dtype=np.uint64), int(rng.integers(1, 12))
        key = [(int(x >> np.uint64(32)) | 1, i) for i, x in enumerate(h)]
        want = set()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for c in range(a, b):
                left = right = c
                while left > a and key[left - 1] > key[c]:
                    left -= 1
                while right < b - 1 and key[right + 1] > key[c]:
                    right += 1
                if right - left + 1 >= width:
                    want.add((c, left, right))
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, at, width)), strict=True)) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizers(rows, name):
    import public_tokenizers

    e = encoder(public_tokenizers.path(name))
    texts = [r[1] or "" for r in rows] + ["  a  b ", "a \n b", "x\ty  z\n\n", "<|endoftext|> q", "don't 's", "é ́x", "a\x1cb c", "　y"]
    for _ in range(2):
        ids, at = e.encode(*shared.bytes_of(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, docs, rows):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    uri = shared.shared_dir(spark)
    got = {r["doc_id"]: r for r in token_files.read(token_files.write(docs, path, 1, uri), uri).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = np.array([*encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_url_rules_and_aliases(spark):
    page = lambda link: f'<link rel="canonical" href="{link}">'
    made = [
        (1, "https://a.example.org/es/x", ""), (2, "http://b.net/1", page("https://a.example.org/es/x")), (3, "http://c.net/2", '<meta http-equiv="refresh" content="0; url=http://b.net/1">'),
        (4, "http://x.com/de/1", page("http://y.com/fr/1")), (5, "http://y.com/fr/1", None), (6, "http://z.net/", page("http://x.com/de/1")), (7, None, "x"), (8, "nothing", None), (9, "HTTP://A.EXAMPLE.ORG/en/12#q", ""), (10, "http://solo.net?q", page("/t")),
    ]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("example.org/en/1", "block"), 10: (None, "allow")}


def plain_model(texts: list[str | None], order: int):
    """Interpolated modified Kneser-Ney by plain counting: P(word | words before) and the unigram counts."""
    seqs = [["<s>", *words(t), "</s>"] for t in texts]
    grams = {m: collections.Counter(tuple(s[i : i + m]) for s in seqs for i in range(len(s) - m + 1)) for m in range(1, order + 1)}
    counts = {order: grams[order]}
    for m in range(order - 1, 0, -1):
        own = collections.Counter(g[1:] for g in grams[m + 1])
        counts[m] = {g: c if g[0] == "<s>" else own[g] for g, c in grams[m].items() if g != ("<s>",)}
    off = {m: language_model._discounts(np.array([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])) for m, c in counts.items()}
    after = {m: collections.defaultdict(list) for m in counts}
    for m, c in counts.items():
        for g, n in c.items():
            after[m][g[:-1]].append(n)
    uni = collections.Counter(w for s in seqs for w in s[1:])

    def p(before: tuple, w: str) -> float:
        m = len(before) + 1
        shorter = p(before[1:], w) if before else 1 / (len(uni) + 1)
        seen = after[m][before]
        if not seen:
            return shorter
        c = counts[m].get((*before, w), 0)
        own = max(c - off[m][min(c, 3) - 1], 0) if c else 0.0
        return (own + sum(off[m][min(n, 3) - 1] for n in seen) * shorter) / sum(seen)

    return p, uni


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = ["a b a c", "a b", "c a b d e", "b b b", "", None, "A z", *(" ".join(rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randrange(1, 30))) for _ in range(40)), "a q b a b zz c a b"]
    df = shared.text_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    spec = language_model.train(df.filter("doc_id < 30"), 8, order)
    got = {r["doc_id"]: r for r in language_model.score(df, spec).collect()}
    p, uni = plain_model(texts[:30], order)
    for before in (("a",), ("a", "b"), ("<s>", "a", "b"), ("b", "b", "c")):
        assert sum(p(before[-order + 1 :], w) for w in uni) + p(before[-order + 1 :], "unknown") == pytest.approx(1.0)
    total = sum(uni.values())
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        s = ["<s>", *words(t), "</s>"]
        assert got[i]["score"] == pytest.approx(sum(np.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s))))
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in s[1:])) and got[i]["train_tokens"] == total
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(s) - 1, sum(uni[w] > 0 for w in s[1:]))


@pytest.mark.parametrize("high", [200, 256, 70_000, 2**40])
def test_counts_come_back_from_few_bytes(tmp_path, high):
    rng = np.random.default_rng(high)
    counts = np.where(rng.random(5000) < 0.01, high, rng.integers(0, 254, 5000))
    counts[:3] = 254, 255, min(high, 256)
    files, top = token_files.open_dir(tmp_path.as_uri())
    kind = language_model._put_counts(files, top, "n", 3, counts)
    places = rng.integers(0, 5000, 800)
    arrays = language_model.Arrays(tmp_path.as_uri(), {3: {"n": kind}})
    assert (arrays.at(3, "n", places) == counts[places]).all() and (arrays.at(3, "n", np.arange(5000)) == counts).all()
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 6500


def test_language_model_of_nothing(spark):
    df = shared.text_of(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"))
    empty = language_model.train(df.limit(0), 8)
    assert language_model.score(df.limit(0), empty).count() == 0
    assert {(r["n_tokens"], round(r["score"], 6)) for r in language_model.score(df, empty).collect()} == {(3, 0.0), (1, 0.0)}
    assert [r["n_known"] for r in language_model.score(df.limit(1), language_model.train(df, 8)).collect()] == [3]


def test_longer_contexts_predict_held_out_texts_better(spark):
    rng = random.Random(5)
    tellings = [f"the {a} of {b} was {c} by {d}" for a, b, c, d in zip(*[[prose(rng, 2) for _ in range(30)] for _ in range(4)], strict=True)]
    rows = [(i, " ".join(rng.choices(tellings, k=4))) for i in range(300)]
    df = shared.text_of(spark.createDataFrame(rows, "doc_id long, text string"))
    held = df.filter("doc_id % 5 = 0")
    sums = [language_model.score(held, language_model.train(df.filter("doc_id % 5 <> 0"), 8, order)).agg(F.sum("score")).first()[0] for order in (2, 3)]
    assert sums[0] < sums[1] < 0


def test_packing_is_whole_and_gapless(docs):
    out = packing.pack_documents(docs, capacity=64).collect()
    per = collections.defaultdict(list)
    for r in out:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in out)
    assert len(per) <= total / 64 * 1.1 + 2 and len({(r["doc_id"], r["piece"]) for r in out}) == len(out)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_benchmark_items_are_found(spark, rows):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (30, 12, 3)] + [None, ""]
    changed = items[0].split()
    changed[29] = "zz"
    made = [(1, prose(rng, 20) + " " + items[0].upper() + " " + prose(rng, 9)), (2, prose(rng, 5) + " " + " ".join(changed)), (3, items[1]), (4, "x " + items[2] + " y"), (5, prose(rng, 90)), (6, None), (7, " ".join(items[0].split()[:12]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in made], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["similarity"]) for r in decontaminate.matches(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1), (4, 2)} and got[1, 0] == (20, 1.0) and got[2, 0][1] < 1
    assert {r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()} == {5, 6, 7}


def test_blocks_of_the_benchmark_change_no_weight(spark, monkeypatch):
    rng = random.Random(14)
    common = prose(rng, 12)
    items = [(i // 2, f"{prose(rng, 9)} {common} {prose(rng, 9)}") for i in range(40)] + [(50, common)] * 9 + [(None, None), (51, "")]
    made = [(i, t if i % 3 else " ".join([*t.split()[:-2], "p", "q"])) for i, (_, t) in enumerate(items[:40])] + [(90, common)]
    df, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontaminate.matches(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    parts = decontaminate.indexes(bench)
    assert [len(p.value["ids"]) for p in parts] == [7] * 7 + [2]
    assert sorted(tuple(r) for r in decontaminate.matches(df, bench).collect()) == whole and len(whole) > 40


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing that any document holds here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.filter(F.length("text") > 0).collect()}
    assert {3, 4, 5, 44} <= ids and not {40, 41} & ids
