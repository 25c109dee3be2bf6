"""The corpus operators' methods against plain versions: fences, templates, packing plans, packed ids, recall of passages and benchmark items."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import classifier, decontaminate, jaccard_join, license_scan, packing, quality_rules, shared, substring_dedup, url_filter
from tapeloom.llm.encode import encoder


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_fences_and_verdicts_against_a_plain_version(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        t = prose(rng, rng.randint(55, 90)).split()
        if rng.random() < 0.3:
            t[3:3] = ["%"] * rng.randint(1, 4)
        if i % 97 == 0:
            t = [w * 4 for w in t]
        rows.append((i, " ".join(t), "en" if i % 3 else None, f"s{i % 4 if i < 480 else 9}"))
    rows += [(900, None, "en", "s1"), (901, "", "xx", "s1"), (902, "short", "en", "s1"), (1, rows[1][1], rows[1][2], rows[1][3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("m", F.lit(1)).withColumn("kept", F.lit("x")).repartition(4)
    measured = shared.materialize(quality_rules.measure(df, "doc_id"))
    values = {k: v for k, v in quality_rules.ratios().items()}
    flat = measured.select("doc_id", "lang", "source", (~quality_rules.base_failed()).alias("ok"), *(v.alias(k) for k, v in values.items())).collect()

    def quantiles(keep):
        out = {}
        for k in values:
            bins = sorted(math.ceil(math.log(r[k]) / math.log(quality_rules.GAMMA) - 1e-9) for r in flat if r["ok"] and keep(r) and r[k] > 0)
            if bins:
                out[k] = (len(bins), {n: quality_rules.GAMMA ** bins[max(0, math.ceil(q * len(bins) - 1e-9) - 1)] for n, q in quality_rules._SHARES.items()})
        return out

    every = quantiles(lambda r: True)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    rejected = 0
    for r in flat:
        ok = r["ok"]
        mine, wide = quantiles(lambda x: x["lang"] == r["lang"] and x["source"] == r["source"]), quantiles(lambda x: x["lang"] == r["lang"])
        for k in values if ok else ():
            if k not in every:
                continue
            q = dict(every[k][1])
            for n, level in (x[k] for x in (wide, mine) if k in x):
                q = {b: (n * level[b] + quality_rules.PRIOR * q[b]) / (n + quality_rules.PRIOR) for b in q}
            high = max(q["b50"] + 2 * (q["b95"] - q["b50"]), q["b99"])
            low = min(q["b50"] - 2 * (q["b50"] - q["b05"]), q["b01"]) / quality_rules.GAMMA
            ok = ok and r[k] <= high * (1 + 1e-9) and (k != "mean_word" or r[k] >= low * (1 - 1e-9))
        assert got[r["doc_id"]] == ok
        rejected += r["ok"] and not ok
    assert rejected >= 3 and quality_rules.keep_good(df).columns == df.columns
    one, two = (quality_rules.sketches(measured.filter(F.col("doc_id") % 2 == i)) for i in (0, 1))
    both = one.unionByName(two).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(str, both.collect())) == sorted(map(str, quality_rules.sketches(measured).collect()))
    assert quality_rules.judge(df.limit(0)).count() == 0


def as_pattern(template):
    out = []
    for m in license_scan._MARK.finditer(template.lower()):
        token = m.group()
        out.append("(?:" if token == "<<optional>>" else ")?" if token == "<<end>>" else rf"(?:\S+ ){{1,{m.group(1)}}}" if m.group(1) else re.escape(token) + " ")
    return re.compile("(?<!\\S)" + "".join(out))


def test_templates_against_regular_expressions(spark):
    rng = random.Random(4)
    made = []
    for templates in license_scan.TEMPLATES.values():
        for t in templates:
            words = []
            depth = skipped = 0
            for m in license_scan._MARK.finditer(t.lower()):
                token = m.group()
                if token == "<<optional>>":
                    depth += 1
                    skipped = skipped or (depth if rng.random() < 0.5 else 0)
                elif token == "<<end>>":
                    skipped = 0 if skipped == depth else skipped
                    depth -= 1
                elif not skipped:
                    words += [prose(rng, rng.randint(1, int(m.group(1))))] if m.group(1) else [token]
            whole = f"{prose(rng, 5)} {', '.join(words)}. {prose(rng, 5)}"
            made += [whole, whole.replace(max(" ".join(words).split(), key=len), "other", 1).title()]
    made += [None, "", " cc by nc" * 3000, "mit license"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumn("labels", F.lit("x"))
    patterns = {label: [as_pattern(t) for t in ts] for label, ts in license_scan.TEMPLATES.items()}
    for r in license_scan.scan(df).collect():
        line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (made[r["doc_id"]] or "").lower())) + " "
        want = {label for label, ps in patterns.items() if any(p.search(line) for p in ps)} | {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in " " + line}
        assert r["labels"] == ",".join(sorted(want)), made[r["doc_id"]]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_plans_hold_every_piece_and_few_bins():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([12, 30, 64])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        plan = packing.plan(dict(counts), capacity)
        held = collections.Counter()
        for n, pattern in plan:
            assert sum(pattern) <= capacity and sum(k > capacity // 3 for k in pattern) <= 2 + (capacity % 3 > 0)
            for k in pattern:
                held[k] += n
        assert held == counts
        free = []  # plain best fit, longest first
        for k in sorted(counts.elements(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= k]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= k
            else:
                free.append(capacity - k)
        assert sum(n for n, _ in plan) <= len(free) * 1.05 + 2


def test_whole_texts_do_not_fill_the_pool():
    import public_tokenizers

    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for i in range(6):
        texts = [prose(rng, 30) + "\n\n  " + prose(rng, 200) for _ in range(20)]
        ids, at = e.encode(*shared.bytes_of(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.filled < 6 * e.n + 1000


def test_passages_by_brute_force(spark):
    """Planted 60-word passages with replaced, inserted and deleted words, at shingle similarities down to 0.75; strangers share common phrases."""
    rng = random.Random(21)
    made, want = [], set()
    common = [prose(rng, 20) for _ in range(3)]

    def add(words):
        made.append((len(made), f"{prose(rng, 40)} {rng.choice(common)} {' '.join(words)} {prose(rng, 40)}"))
        return len(made) - 1

    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(want) < 60:
        w = prose(rng, 80).split()
        y = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randint(8, len(y) - 9)
            y[i : i + rng.choice([0, 1])] = [] if rng.random() < 0.3 else ["n" + str(rng.random())]
        if len(grams(w) & grams(y)) >= 0.75 * len(grams(w) | grams(y)):
            want.add((add(w), add(y)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["of_doc_id"], r["doc_id"]) for r in substring_dedup.repeats(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_cut_keeps_columns_of_any_name(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(1, f"{prose(rng, 20)} {passage}", 1, 2, "x"), (2, f"{passage} tail here", 3, 4, None), (3, None, 5, 6, "z"), (None, passage, 7, 8, "n"), (4, passage, 9, 9, ""), (5, passage.upper(), 9, 9, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, id long, spans int, `row` string")
    out = substring_dedup.cut(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "tail here", 3: None, None: passage, 4: "", 5: ""}
    assert substring_dedup.cut(df.limit(0)).count() == 0


def test_longest_matches_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x, y = (rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        size, where = substring_dedup.longest_matches(x, y)
        for j in range(len(y)):
            best = 0
            for i in range(len(x)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                best = max(best, n)
            assert size[j] == best and (x[where[j] : where[j] + best] == y[j : j + best]).all()


def test_benchmark_items_by_brute_force(spark):
    rng = random.Random(30)
    items = [prose(rng, rng.randint(8, 40)) for _ in range(80)]
    made = []
    for k, t in enumerate(items):
        w = t.split()
        if k % 2:
            i = rng.randint(0, len(w) - 1)
            w[i : i + 1] = [] if k % 4 == 1 else ["zz"]
        made.append((k, f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}"))
    df, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()}
    grams = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in items]
    df_of = collections.Counter(g for c in grams for g in c)
    weight = lambda g: math.log1p(len(items) / max(df_of[g], 1)) if df_of[g] else math.log1p(len(items))
    want = set()
    for d, t in made:
        w = t.split()
        for k, item in enumerate(items):
            n = len(item.split())
            best = 0.0
            for a in range(len(w) - n + 1):
                mine = collections.Counter(tuple(w[i : i + 5]) for i in range(a, a + n - 4))
                if mine.keys() & grams[k].keys():
                    least = sum(min(mine[g], c) * weight(g) for g, c in grams[k].items())
                    best = max(best, least / (sum(c * weight(g) for g, c in mine.items()) + sum(c * weight(g) for g, c in grams[k].items()) - least))
            if best >= 0.75 - 1e-9:
                want.add((d, k))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40


def test_null_ids_and_edges(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (1, None, 0), (1, "", None)], "doc_id long, text string, quality int")
    assert all(r["held_out"] is not None for r in classifier.score(df, classifier.train(df, df)).collect())
    pages = spark.createDataFrame([(None, None, None, 1), (2, "http://a.com/x", '<link rel=canonical href="http://b.example.org/es/">', 2)], "page_id long, url string, html string, component int")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()} == {None: "allow", 2: "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "same words in each of these texts") for i in range(6)] + [(7, "same words in each of these")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.join(many).collect()} == {0, 7}


def plain_features(text: str) -> set:
    w, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    return {*w, *zip(w, w[1:], strict=False), *(raw[i : i + 3] for i in range(len(raw) - 2))}


@pytest.mark.parametrize("seed", [1, 2])
def test_classifier_against_a_plain_solver(spark, seed):
    """Primal objective and margins against projected gradients on the whole dual, features unhashed.

    Run to its end, coordinate descent meets the plain optimum; the twelve rounds that the operator makes stop above it
    (by 12 % and 5 % on these rows), so there the margins' signs and the held-out labels are what has to agree.
    """
    rng = random.Random(seed)
    rows = [(i, prose(rng, 30) + (" %x% %y%" if (i % 2) ^ (rng.random() < 0.05) else " fine words"), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = classifier.train(df, df)
    out = {r["doc_id"]: r for r in classifier.score(df, model).collect()}
    assert [i for i in out if out[i]["held_out"]] and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())

    learnt = [r for r in rows if not out[r[0]]["held_out"]]
    labels = np.array([y for _, _, y in learnt])
    seen = [collections.Counter(f for (_, t, y) in learnt if y == k for f in plain_features(t)) for k in (0, 1)]
    places = 1 << classifier.BITS
    norm = [places + sum(c.values()) for c in seen]
    every = sorted({f for c in seen for f in c}, key=repr)
    number = {f: j for j, f in enumerate(every)}
    ratio = np.array([np.log((seen[1][f] + 1) / norm[1]) - np.log((seen[0][f] + 1) / norm[0]) for f in every])
    unmet = np.log(norm[0] / norm[1])

    def scaled(text: str) -> np.ndarray:
        v, found = np.zeros(len(every)), plain_features(text)
        for f in found & number.keys():
            v[number[f]] = ratio[number[f]]
        return v / np.sqrt((v**2).sum() + unmet**2 * len(found - number.keys()))

    own = np.arange(len(learnt)) % 5 != 4  # the others fit the curve
    x = np.array([[*scaled(t), 1.0] for _, t, _ in learnt])[own]
    sign = np.where(labels[own] == 1, 1.0, -1.0)
    most = np.where(labels[own] == 1, 1.0, max(1.0, labels.mean() / (1 - labels.mean())))
    q = (x @ x.T) * np.outer(sign, sign)
    alpha, step = np.zeros(len(q)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    w = x.T @ (alpha * sign)
    objective = lambda square, margins: square / 2 + (most * np.maximum(0, 1 - sign * margins)).sum()
    best = objective(w @ w, x @ w)

    plain = {i: np.append(scaled(t), 1.0) @ w for i, t, _ in rows}
    raw, bounds = shared.bytes_of(pa.array([t for _, t, _ in learnt]))
    hashed = [f.copy() for f in classifier.features(raw, bounds)]
    for epochs, above in ((200, 0.01), (12, 0.15)):
        m = classifier.fit(hashed, labels.astype(float), epochs=epochs)
        weight, to = m["weight"].astype(float), m["ratio"].astype(float)
        margins = np.array([weight[f] @ to[f] / np.sqrt((to[f] ** 2).sum()) + m["bias"] for f in hashed])
        mine = objective(weight @ weight + m["bias"] ** 2, margins[own])
        assert best * 0.99 < mine < best * (1 + above)
        apart = margins - np.array([plain[i] for i, _, _ in learnt])
        assert np.sqrt((apart**2).mean()) < (0.05 if epochs == 200 else 0.2) * np.std(list(plain.values()))
    shipped = (np.log(out[i]["score"] / (1 - out[i]["score"])) for i, _, _ in learnt)
    assert np.allclose(list(shipped), m["slope"] * margins + m["intercept"], atol=1e-3)

    held = [i for i in out if out[i]["held_out"]]
    margin = {i: np.log(out[i]["score"] / (1 - out[i]["score"])) - model["intercept"] for i in held}
    assert sum((margin[i] > 0) == (plain[i] > 0) for i in held) >= 0.97 * len(held)
    assert sum((out[i]["score"] >= 0.5) == bool(rows[i][2]) for i in held) >= 0.85 * len(held)


def test_licenses_as_they_stand_in_files(spark):
    """Texts written out by hand, with bullets, numbers and comment marks, not made from the templates."""
    as_is = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

    def bsd(marks, third=True):
        parts = ["Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."]
        parts += ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."] if third else []
        return "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n" + "\n\n".join(f"{m} {p}" for m, p in zip(marks, parts)) + "\n\n" + as_is

    zlib_text = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
      Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
      1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
      2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
      3. This notice may not be removed or altered from any source distribution."""
    texts = {
        bsd("***"): {"bsd", "bsd-3"}, bsd("---"): {"bsd", "bsd-3"}, bsd(["1.", "2.", "3."]): {"bsd", "bsd-3"}, bsd("**", third=False): {"bsd", "bsd-2"}, zlib_text: {"zlib"},
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main();": {"mit", "apache-2"}, "# SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND Zlib": {"gpl", "bsd-3", "zlib"}, "SPDX-License-Identifier: ISC": {"isc"},
        "an identifier of a license is not one of SPDX": set(),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_items_with_a_common_opening_cost_no_more_than_others(spark):
    """Benchmarks share openings: their shingles are looked up for no item, and all planted items are found all the same."""
    import time

    rng = random.Random(21)
    opening = "please answer the following question with care"
    items = [(i, opening + " " + " ".join(f"w{rng.randrange(50_000)}" for _ in range(40))) for i in range(2000)]
    index = decontaminate.build_index([i for i, _ in items], [t for _, t in items])
    text = " ".join(f"{opening} v{n}" for n in range(2000))
    planted = items[77][1].split()
    planted[30] = "changed"
    raw, bounds = shared.bytes_of(pa.array([text + " " + items[5][1] + " tail", "x " + " ".join(planted), opening]))
    began = time.time()
    t, i, *_, sim = decontaminate.find(index, raw, bounds)
    assert time.time() - began < 2
    assert list(zip(t.tolist(), i.tolist(), strict=True)) == [(0, 5), (1, 77)] and sim[0] == 1.0


def test_rarest_shingles_lose_no_window(spark):
    """Every window at or above the similarity holds one of the item's rarest shingles, whatever words have been changed, put in or left out."""
    rng = random.Random(22)
    items = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 60))) for _ in range(200)]
    index = decontaminate.build_index(list(range(200)), items)
    rarest = {(int(k), int(i)) for k in range(len(index["keys"])) for i in index["post_item"][index["post"][k] : index["post"][k + 1]]}
    for i, item in enumerate(items):
        ws = item.split()
        for _ in range(10):
            new = [w for w in ws for w in ([] if rng.random() < 0.02 else [w, "new"] if rng.random() < 0.02 else ["other"] if rng.random() < 0.02 else [w])]
            raw, bounds = shared.bytes_of(pa.array([" ".join(new)]))
            h, _ = shared.shingles(*shared.word_hashes(raw, bounds), 5)
            own, n_own = np.unique(h, return_counts=True)
            mine, n_mine = np.unique(index["shingle"][index["to"][i] : index["to"][i + 1]], return_counts=True)
            weight = dict(zip(index["keys"][mine].tolist(), (n_mine * index["idf"][mine]).tolist(), strict=True))
            each = dict(zip(index["keys"].tolist(), index["idf"].tolist(), strict=True))
            have = dict(zip(own.tolist(), n_own.tolist(), strict=True))
            least = sum(min(weight[k], have.get(k, 0) * each[k]) for k in weight)
            both = sum(weight.values()) + sum(n * each.get(k, index["unseen"]) for k, n in have.items()) - least
            if both and least / both >= decontaminate.SIMILARITY:
                numbers = np.searchsorted(index["keys"], own)
                assert any((int(k), i) in rarest for k in numbers)


@pytest.mark.parametrize("edits", [267, 400, 440])
def test_a_long_passage_with_many_edits_is_one(edits):
    """Chains of more runs than are compared at once: the parts overlap, so no edit parts a passage."""
    rng = np.random.default_rng(edits)
    x = rng.integers(1, 2**63, 16_000, dtype=np.uint64)
    y = x.copy()
    y[np.linspace(10, 15_990, edits).astype(int)] = rng.integers(1, 2**63, edits, dtype=np.uint64)
    found = substring_dedup.passages(x, np.array([0, len(x)]), y, np.array([0, len(y)]))
    assert len(found) == 1 and found[0][1] <= 10 and found[0][2] >= 15_990 and found[0][5] >= 0.75
