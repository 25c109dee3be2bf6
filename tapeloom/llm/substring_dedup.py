"""Substring dedup with compact windows.

A text is its sequence of five-word shingles. For each of ``HASHES`` hash functions, a node of the
Cartesian tree over the hashed sequence (a least value at c, and the span l..r in which it is the
least) stands for all its subsequences around c, which share that min-hash: a compact window.
Only nodes with spans of at least the shortest passage are kept (about 2 n / length of them); spans reach
at most ``REACH`` places from c, as longer passages consist of shorter ones.

1. Texts of the same words are one class: its least id stands for the others, which are wholly repeated.
2. Of all windows, those stay whose min-hash another document has too. Documents that share min-hashes of at least
   two hash functions with a common first document (their hub) are compared with it at once: most pairs.
3. Interval join of what no verified passage covers: windows of one document and of different hash functions whose
   intervals intersect in at least a passage's length, all minima inside, are the signature of all subsequences in
   the intersection. Documents that share a signature of two windows agree in two of the H = 5 functions over
   intersecting intervals; passages of similarity s do with probability 1 - (1 - s)**H - H s (1 - s)**(H - 1)
   (0.98 at s = 0.75).
4. Each signature's documents meet one of them, its hub (a passage in m documents costs m pairs). What is left apart
   then meets another hub by signatures of three windows, of four and of all five: common phrases that are no
   passages drop out, as their neighbourhoods differ. Those of five meet sixteen times as many hubs in each round
   until none is left. So equal passages are never left apart; similar ones that a hub leaves apart (it holds less of the
   passage, say) have to agree in more functions.
5. A pair is verified over all places that its signatures reach: equal runs of shingles are chained over
   replaced, inserted and deleted words.

A match has at least ``MIN_WORDS`` words on both sides, begins and ends with five equal words, and has a
shingle similarity of 0.75. The occurrence in the document of the least id stays; the later ones are what
``cut`` removes. In texts that repeat themselves much, each place goes with its longest match alone.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Cases: null, empty and shorter texts have no
windows; rows of one doc_id are versions of one document and are not compared; rows without id are
left alone; ``cut`` keeps all columns of docs, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.encode import gather

K = 5
MIN_WORDS = 50
WIDTH = MIN_WORDS - K + 1
HASHES = 5
SIMILARITY = 0.75
REACH = 2 * WIDTH
#: Runs of a chain that are compared at once, and those that neighbouring parts of a longer chain have in common.
RUNS = 256
OVERLAP = 64
#: Words kept on both sides of the outermost signatures.
MARGIN = 2 * MIN_WORDS + 2 * K
#: Places of a document that have a shingle in common with another one, in some WIDTH of them, without which nothing in it is similar.
LEAST = 30
_SALTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 16, dtype=np.uint64)
#: Columns of windows: min-hash, document, and c, c - l, r - c and the hash function packed into one number; n: see ``windows``.
_ROWS = "key long, doc long, at long, n int"


def compact_windows(hashes: np.ndarray, at: np.ndarray, width: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian tree's nodes of at least ``width`` places, over all texts (at: their offsets); l and r at most ``reach`` from c."""
    n, texts = len(hashes), len(at) - 1
    # one place between texts, less than all hashes, ends every span; ties go to the left
    place = np.arange(n) + np.repeat(np.arange(texts), np.diff(at))
    key = np.zeros(n + texts, np.uint64)
    key[place] = (hashes >> np.uint64(32) | np.uint64(1)) << np.uint64(32)
    key |= np.arange(n + texts, dtype=np.uint64)
    levels, step = [key], 1
    longest = int(np.diff(at).max(initial=0))
    while step * 2 <= max(longest if reach is None else min(longest, reach), width):
        last = levels[-1]
        levels.append(np.concatenate((np.minimum(last[:-step], last[step:]), last[len(last) - step :])))
        step *= 2
    level = int(np.log2(width))
    if len(key) < width or level >= len(levels):
        return (np.zeros(0, np.int64),) * 3
    least = np.minimum(levels[level][: len(key) - width + 1], levels[level][width - (1 << level) : len(key) - (1 << level) + 1])
    c = (least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    c = c[key[c] >> np.uint64(32) > 0]
    own, right, left = key[c], c.copy(), c.copy()
    for j in range(len(levels) - 1, -1, -1):  # longest spans whose least is not below their own
        step = 1 << j
        to = np.minimum(right + 1, len(key) - 1)
        ok = (right + step < len(key)) & (levels[j][to] > own)
        right[ok] += step
        to = np.maximum(left - step, 0)
        ok = (left - step >= 0) & (levels[j][to] > own)
        left[ok] -= step
    text = np.searchsorted(at[1:] + np.arange(texts), c, "right")
    if reach is not None:
        left, right = np.maximum(left, c - reach), np.minimum(right, c + reach)
    return c - text, left - text, right - text


def windows(docs: DataFrame) -> DataFrame:
    """All compact windows of all hash functions. Rows with n stand for whole texts: key and at are 128 bits of all of its n words."""

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            words, at = shared.word_hashes(raw, bounds)
            h, to = shared.shingles(words, at, K)
            out = []
            for i in range(HASHES):
                salted = shared.mix(h ^ _SALTS[i])
                c, left, right = compact_windows(salted, to, WIDTH, REACH)
                text = np.searchsorted(to, c, "right") - 1
                out.append((salted[c], text, (c - to[text]) << 24 | (c - left) << 16 | (right - c) << 8 | i, np.zeros(len(c), np.int64)))
            long = np.flatnonzero(np.diff(at) >= MIN_WORDS)
            one, two = (shared.run_hashes(w, at[long], at[long + 1]) for w in (words, words ^ _SALTS[15]))
            out.append((one, long, shared.signed(two), np.diff(at)[long]))
            key, text, place, n = (np.concatenate(x) for x in zip(*out, strict=True))
            o = np.argsort(text, kind="stable")
            yield shared.arrow(key=shared.signed(key[o]), doc=batch.column(0).take(pa.array(text[o])), at=place[o], n=pa.array(n[o].astype(np.int32), mask=n[o] == 0))

    return docs.mapInArrow(run, _ROWS)


def place_of(at: Column) -> Column:
    return F.shiftright(at, 24).cast("int")


def classes(rows: DataFrame) -> DataFrame:
    """(doc_id, of_doc_id, n_words, check) of texts whose words another document of a lesser id has, all of them. Ids of several texts are left out."""
    whole = rows.filter("n is not null").groupBy("doc").agg(F.collect_set(F.struct("key", "at", "n")).alias("texts"))  # versions of one id
    one = shared.materialize(whole.filter(F.size("texts") == 1).select("doc", F.col("texts")[0]["key"].alias("key"), F.col("texts")[0]["at"].alias("at"), F.col("texts")[0]["n"].alias("n")))
    least = one.groupBy("key", "at", "n").agg(F.min("doc").alias("of"), F.count("*").alias("m")).filter("m > 1").drop("m")
    out = one.join(least, ["key", "at", "n"]).filter("doc > of").select(F.col("doc").alias("doc_id"), F.col("of").alias("of_doc_id"), F.col("n").cast("long").alias("n_words"), F.col("key").alias("check"))
    return shared.materialize(out, one)


def met(rows: DataFrame) -> DataFrame:
    """The rows whose min-hash more than one document has."""
    keys = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low != high").select("key")
    return rows.join(shared.materialize(keys), "key")


def paired_at_once(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents a < b with the outermost places of the min-hashes that they share, where a is the first document of windows of
    at least two hash functions. Most pairs of near-duplicate passages are such; the others meet by signatures."""
    hub = [F.min(F.struct("doc", place_of(F.col("at")).alias("c"))).alias("low"), F.max(F.struct((-F.col("doc")).alias("doc"), place_of(F.col("at")).alias("c"))).alias("high")]
    hubs = rows.groupBy("key").agg(*hub).select("key", F.col("low.doc").alias("a"), F.col("low.c").alias("a0"), F.col("high.c").alias("a1"))
    hubs = shared.materialize(hubs)  # a stage of its own: the rows of one key that many documents have can then be split in the join
    c, kind = place_of(F.col("at")), F.bit_or(F.expr("shiftleft(1, cast(at & 255 as int))"))
    pairs = rows.join(shared.small(hubs), "key").filter("doc != a").groupBy("a", F.col("doc").alias("b"))
    pairs = pairs.agg(F.min("a0").alias("a_low"), F.max("a1").alias("a_high"), F.min(c).alias("b_low"), F.max(c).alias("b_high"), F.bit_count(kind).alias("kinds"))
    return shared.materialize(pairs.filter("kinds > 1").drop("kinds"), hubs)


def signed_sets(size: int, doc: np.ndarray, key: np.ndarray, kind: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, doc, low, high): the signatures of ``size`` hash functions of the windows (sorted by doc, c), each once a document with its outermost places.

    Intervals are joined one by one: what a set of windows has in common holds all their minima and is WIDTH long at least."""
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    ends = np.maximum.reduceat(right, np.flatnonzero(new)).astype(np.int64) + 2
    base = np.concatenate(([0], np.cumsum(ends)[:-1]))[np.cumsum(new) - 1]
    at, left, right = c + base, left + base, right + base
    bit = np.int64(1) << kind.astype(np.int64)
    own = shared.mix(key.view(np.uint64) ^ (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    first = last = np.arange(len(at))
    since, until, kinds, both = left, right, bit, own
    for _ in range(size - 1):
        n = np.searchsorted(at, until, "right") - last - 1
        i, j = np.repeat(np.arange(len(last)), n), gather(last + 1, n)
        low, high = np.maximum(since[i], left[j]), np.minimum(until[i], right[j])
        ok = (left[j] <= at[first[i]]) & (kinds[i] & bit[j] == 0) & (high - low + 1 >= WIDTH)
        i, j, since, until = i[ok], j[ok], low[ok], high[ok]
        with np.errstate(over="ignore"):
            first, last, kinds, both = first[i], j, kinds[i] | bit[j], both[i] + own[j]
    if not len(both):
        return (np.zeros(0, np.int64),) * 4
    both = shared.mix(both)
    o = np.lexsort((both, doc[first]))
    first, last, both = first[o], last[o], both[o]
    starts = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]) | (doc[first][1:] != doc[first][:-1]))))
    return both[starts].view(np.int64), doc[first][starts], np.minimum.reduceat(c[first], starts), np.maximum.reduceat(c[last], starts)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, doc, low, high) of all windows' signatures of ``size`` hash functions (see ``signed_sets``)."""

    def run(batches):
        for t in shared.whole_groups(batches, "doc"):
            doc, key, at = (t.column(x).to_numpy() for x in ("doc", "key", "at"))
            c = at >> 24
            found = signed_sets(size, doc, key, at & 255, c, c - (at >> 16 & 255), c + (at >> 8 & 255))
            yield shared.arrow(**dict(zip(("key", "doc"), found[:2], strict=True)), **{n: x.astype(np.int32) for n, x in zip(("low", "high"), found[2:], strict=True)})

    return shared.materialize(rows.repartition("doc").sortWithinPartitions("doc", "at").mapInArrow(run, "key long, doc long, low int, high int"))


def paired(rows: DataFrame, turn: int = 0, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of documents a < b, one of which is a hub of a key of rows (key, doc, low, high), with the outermost places of the keys that
    they share; and the rows of other documents than hubs. Hubs are the first document, or in later turns a random one in each of ``parts``
    hashed parts of a key's documents."""
    rank = F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "doc"), F.lit(parts)))
    hub = F.min(F.struct(rank.alias("rank"), "doc", "low", "high")).alias("hub")
    hubs = shared.materialize(rows.groupBy("key", "part").agg(hub, F.min("doc").alias("least"), F.max("doc").alias("most")).filter((F.lit(parts) > 1) | (F.col("least") != F.col("most"))))
    to = hubs.select("key", F.col("part").alias("p"), F.col("hub.doc").alias("h"), F.col("hub.low").alias("h0"), F.col("hub.high").alias("h1"))
    if parts > 1:
        several = hubs.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least != most").select("key")
        to = shared.materialize(to.join(several, "key"))
    met = shared.materialize(rows.join(shared.small(to), "key").filter("doc != h"), *([to] if parts > 1 else []))
    of = lambda x, y: F.when(F.col("doc") < F.col("h"), F.col(x)).otherwise(F.col(y))
    places = met.select(F.least("doc", "h").alias("a"), F.greatest("doc", "h").alias("b"), of("low", "h0").alias("a0"), of("high", "h1").alias("a1"), of("h0", "low").alias("b0"), of("h1", "high").alias("b1"))
    pairs = places.groupBy("a", "b").agg(F.min("a0").alias("a_low"), F.max("a1").alias("a_high"), F.min("b0").alias("b_low"), F.max("b1").alias("b_high"))
    return shared.materialize(pairs, hubs), met.filter("part = p").select("key", "doc", "low", "high")


def uncovered(rows: DataFrame, found: DataFrame, *places: Column) -> DataFrame:
    """The rows of which one of the places does not lie in a verified passage of its document."""
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans"))  # at most a document's keys
    spans = shared.small(shared.materialize(spans))
    inside = lambda c: F.exists("spans", lambda s: (c >= s["first_word"]) & (c + K <= s["first_word"] + s["n_words"]))
    outside = F.col("spans").isNull()
    for c in places:
        outside = outside | ~inside(c)
    return rows.join(spans, "doc", "left").filter(outside).drop("spans")


def within(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The windows that stand inside the reach of one of their document's signatures."""
    spans = shared.small(shared.materialize(keys.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("spans"))))  # at most a document's signatures
    c = place_of(F.col("at"))
    return rows.join(spans, "doc").filter(F.exists("spans", lambda s: (c >= s["low"]) & (c <= s["high"]))).drop("spans")


def longest_matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of y the length of its longest match in x, and a place in x where it stands (suffixes sorted by doubling)."""
    n = len(x) + 1
    rank = np.concatenate((np.unique(np.concatenate((x, y)), return_inverse=True)[1] + 2, [0]))
    rank = np.concatenate((rank[: len(x)], [1], rank[len(x) :]))  # 1 ends x, 0 ends y
    ranks, step = [rank], 1
    while step < len(y):
        last = ranks[-1].astype(np.int64)
        after = np.zeros(len(last), np.int64)
        after[:-step] = last[step:]
        ranks.append(np.unique(last * (len(last) + 2) + after, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    of_x = order < len(x)
    index = np.arange(len(order))
    before = np.maximum.accumulate(np.where(of_x, index, -1))
    behind = np.minimum.accumulate(np.where(of_x, index, len(order))[::-1])[::-1]
    place = np.empty(len(order), np.int64)
    place[order] = index
    own = place[n : n + len(y)]
    best, where = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    for near in (before[own], behind[own]):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        p, q, size = n + ok, order[near[ok]], np.zeros(len(ok), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (p + (1 << k) <= len(rank) - 1) & (q + (1 << k) <= len(rank) - 1)
            same = np.zeros(len(ok), bool)
            same[inside] = ranks[k][p[inside]] == ranks[k][q[inside]]
            p, q, size = p + (same << k), q + (same << k), size + (same << k)
        more = size > best[ok]
        best[ok[more]], where[ok[more]] = size[more], order[near[ok]][more]
    return best, where


def equal_runs(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray, base: int) -> np.ndarray:
    """Rows (place in y, place in x, shingles) of equal runs of the shingles x and y; order[low:high] - base of a place in y are its places in x.

    All longest ones; if a place of y has many in x, of each place the longest match alone."""
    n = high - low
    if n.sum() > 8 * (len(x) + len(y)):
        size, where = longest_matches(x, y)
        begin = np.flatnonzero((size > 0) & (size >= np.concatenate(([1], size[:-1]))))
        return np.stack((begin, where[begin], size[begin]), 1)
    yi, xi = np.repeat(np.arange(len(y)), n), order[gather(low, n)] - base
    shift = yi - xi
    o = np.lexsort((yi, shift))
    yi, xi, shift = yi[o], xi[o], shift[o]
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(yi) > 1) | (np.diff(shift) != 0))))
    end = np.append(begin[1:], len(yi)) - 1
    return np.stack((yi[begin], xi[begin], yi[end] - yi[begin] + 1), 1)


def thinned(found: np.ndarray, places: int) -> np.ndarray:
    """Of runs that are passages by themselves, the fewest that cover what they all cover; and the shorter ones that reach out of them."""
    long = found[found[:, 2] >= WIDTH]
    if len(long) < 2:
        return found
    long = long[np.lexsort((-long[:, 2], long[:, 0]))]
    chosen, end, best, best_end = [], 0, -1, -1
    for i, (begin, n) in enumerate(long[:, [0, 2]].tolist()):
        if begin > end and best >= 0:  # the best of those that begin in what is covered
            chosen.append(best)
            end, best, best_end = best_end, -1, -1
        if begin + n > max(best_end, end):
            if begin > end:
                end = begin
            best, best_end = i, begin + n
    if best >= 0:
        chosen.append(best)
    edge = np.zeros(places + 1, np.int64)
    np.add.at(edge, long[chosen, 0], 1)
    np.add.at(edge, long[chosen, 0] + long[chosen, 2], -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    short = found[found[:, 2] < WIDTH]
    return np.concatenate((long[chosen], short[inside[short[:, 0] + short[:, 2]] - inside[short[:, 0]] < short[:, 2]]))


def chained(found: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start in y, end in y, start in x, end in x, similarity), in words, of the longest stretches of at least MIN_WORDS words in both that are
    similar enough, each of y's words in the best of x's places. Equal runs are chained over at most MIN_WORDS words (longer gaps part
    passages); c common and u other shingles are worth c - 3 u, which is not negative where c / (c + u) >= 0.75."""
    found = thinned(found, len(hy))
    ys, xs, n = found[np.lexsort((found[:, 1], found[:, 0]))].T
    ye, xe = ys + n, xs + n
    total = len(n)
    score, link, cost = n.copy(), np.full(total, -1), np.zeros(total, np.int64)
    first = np.searchsorted(np.maximum.accumulate(ye), ys - MIN_WORDS)
    y0, y1, x0, x1, size, got = (c.tolist() for c in (ys, ye, xs, xe, n, n))  # numbers of one's own are faster than arrays here
    for j in np.flatnonzero(first < np.arange(total)).tolist():
        low, worth, best, loss = int(first[j]), None, -1, 0
        if j - low > 24:  # many runs before this one: at once
            i = slice(low, j)
            over = np.maximum(0, np.maximum(ye[i] - ys[j], xe[i] - xs[j]))
            gap = np.maximum(ys[j] - ye[i], xs[j] - xe[i])
            fit = np.flatnonzero((ys[i] < ys[j]) & (xs[i] < xs[j]) & (n[j] > over) & (gap <= MIN_WORDS))
            if len(fit):
                losses = over[fit] + 3 * (ys[j] - ye[i][fit] + xs[j] - xe[i][fit] + 2 * over[fit])
                at = int((score[i][fit] - losses).argmax())
                best, loss = low + int(fit[at]), int(losses[at])
                worth = int(score[best]) - loss
        else:
            y, x, own = y0[j], x0[j], size[j]
            for i in range(low, j):
                gap_y, gap_x = y - y1[i], x - x1[i]
                over = max(0, -gap_y, -gap_x)
                if x0[i] < x and y0[i] < y and over < own and gap_y <= MIN_WORDS and gap_x <= MIN_WORDS:
                    lost = 7 * over + 3 * (gap_y + gap_x)
                    if worth is None or got[i] - lost > worth:
                        worth, best, loss = got[i] - lost, i, lost
        if best >= 0:
            link[j], cost[j] = best, loss
            got[j] += max(0, worth)
            score[j] = got[j]
    used, out, taken = np.zeros(total, bool), [], np.zeros(len(hy), bool)
    leaves = np.setdiff1d(np.arange(total), link)
    for j in leaves[np.argsort(-score[leaves], kind="stable")].tolist():
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = link[j]
        if ye[path].max() - ys[path[-1]] < WIDTH:
            continue
        found, path = [], path[::-1]
        for a in range(0, max(1, len(path) - OVERLAP), RUNS - OVERLAP):  # parts of a long chain overlap
            found += stretches(np.array(path[a : a + RUNS]), ys, ye, xs, xe, cost, hx, hy, taken)
        out += joined(found, hx, hy) if len(path) > RUNS else found
    return out


def joined(found: list, x: np.ndarray, y: np.ndarray) -> list:
    """Stretches of one chain with those that overlap in both texts made one, where they are similar as one."""
    out: list = []
    for r in sorted(found):
        if out and r[0] < out[-1][1] - K + 1 and out[-1][2] <= r[2] < out[-1][3] - K + 1:
            last = out[-1]
            whole = (last[0], max(last[1], r[1]), last[2], max(last[3], r[3]))
            sim = similar(x[whole[2] : whole[3] - K + 1], y[whole[0] : whole[1] - K + 1])
            if sim >= SIMILARITY:
                out[-1] = (*whole, sim)
                continue
        out.append(r)
    return out


def stretches(at: np.ndarray, ys, ye, xs, xe, cost, x: np.ndarray, y: np.ndarray, taken: np.ndarray) -> list:
    """The longest similar stretches of the chain ``at`` of runs, where not all places of y are taken yet."""
    n, out, todo = ye[at] - ys[at], [], [(0, len(at))]
    value = np.cumsum(n - cost[at])
    while todo:
        low, high = todo.pop()
        if high <= low or min(ye[at[high - 1]] - ys[at[low]], xe[at[high - 1]] - xs[at[low]]) < WIDTH or taken[ys[at[low]] : ye[at[high - 1]]].all():
            continue
        i = at[low:high]
        size = np.minimum(ye[i][None, :] - ys[i][:, None], xe[i][None, :] - xs[i][:, None])
        worth = (n[low:high] - value[low:high])[:, None] + value[low:high][None, :]
        size[(worth < 0) | np.tri(len(i), k=-1, dtype=bool)] = 0
        while size.max() >= WIDTH:
            p, q = np.unravel_index(int(size.argmax()), size.shape)
            a, b = i[p], i[q]
            if taken[ys[a] : ye[b]].all():  # another place in x of words that are already found
                size[p, q] = 0
                continue
            sim = 1.0 if p == q else similar(x[xs[a] : xe[b]], y[ys[a] : ye[b]])
            if sim >= SIMILARITY:
                out.append((int(ys[a]), int(ye[b]) + K - 1, int(xs[a]), int(xe[b]) + K - 1, sim))
                taken[ys[a] : ye[b]] = True
                todo += [(low, low + int(p)), (low + int(q) + 1, high)]
                break
            size[p, q] = 0
    return out


def similar(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def passages(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
    """(pair, start in y, end in y, start in x, end in x, similarity) of the passages of all pairs of word runs (one after another in x and y)."""
    hx, tx = shared.shingles(x, x_at, K)
    hy, ty = shared.shingles(y, y_at, K)
    pair_x, pair_y = (np.repeat(np.arange(len(t) - 1), np.diff(t)) for t in (tx, ty))
    salt = np.uint64(0xA0761D6478BD642F)
    kx, ky = shared.mix(hx ^ pair_x.astype(np.uint64) * salt), shared.mix(hy ^ pair_y.astype(np.uint64) * salt)
    order = np.argsort(kx, kind="stable")
    sorted_x = kx[order]
    low, high = np.searchsorted(sorted_x, ky), np.searchsorted(sorted_x, ky, "right")
    hit = high > low
    hits = np.concatenate(([0], np.cumsum(hit)))
    place = np.arange(len(hy))
    until = np.minimum(place + WIDTH, ty[1:][pair_y])
    # a pair that nowhere has LEAST common shingles among WIDTH has no passage
    dense = hits[until] - hits[place] >= LEAST
    zone = np.zeros(len(hy) + 1, np.int64)
    zone[place[dense]] += 1
    np.subtract.at(zone, until[dense], 1)
    high = np.where(np.cumsum(zone)[:-1] > 0, high, low)  # places outside all such stretches are in no passage
    found = []
    for p in np.unique(pair_y[dense]).tolist():
        own = slice(ty[p], ty[p + 1])
        mine_x, mine_y = hx[tx[p] : tx[p + 1]], hy[own]
        if hit[own].all() and ty[p + 1] - ty[p] >= WIDTH:  # one run, most often
            at = order[low[ty[p]] : high[ty[p]]] - tx[p]
            at = [i for i in at.tolist() if i + len(mine_y) <= len(mine_x) and np.array_equal(mine_x[i : i + len(mine_y)], mine_y)]
            if at:
                found.append((p, 0, len(mine_y) + K - 1, at[0], at[0] + len(mine_y) + K - 1, 1.0))
                continue
        runs = equal_runs(mine_x, mine_y, low[own], high[own], order, int(tx[p]))
        found += [(p, *s) for s in chained(runs, mine_x, mine_y)]
    return found


def faced(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the words of both regions, margins included."""
    near = lambda name: (F.greatest(F.col(f"{name}_low") - MARGIN, F.lit(0)), F.col(f"{name}_high") + MARGIN)
    pairs = pairs.select("a", "b", *(c.alias(f"{name}_{end}") for name in "ab" for c, end in zip(near(name), ("low", "high"), strict=True)))
    sides = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("doc_id"), F.col(f"{x}_low").alias("low"), F.col(f"{x}_high").alias("high")) for x in "ab"))).alias("s")).select("s.*")
    wanted = shared.materialize(sides.groupBy("doc_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    joined = docs.join(shared.small(wanted), "doc_id").select("doc_id", "text", "low", "high")

    def slices(batches):
        for batch, raw, bounds in shared.chunks(batches):
            words, at = shared.word_hashes(raw, bounds)
            low, high = (batch.column(i).to_numpy() for i in (2, 3))
            cut = [words[at[t] + x : min(at[t + 1], at[t] + y)].astype("<u8").tobytes() for t, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
            yield shared.arrow(doc=batch.column(0), at=low, words=pa.array(cut, pa.binary()))

    pieces = shared.materialize(joined.mapInArrow(slices, "doc long, at int, words binary").distinct(), wanted)
    side = lambda x: pieces.select(F.col("doc").alias(x), F.col("at").alias(f"{x}_at"), F.col("words").alias(f"{x}_words"))
    # by a first: the rows that are compared are then dealt by b, not by hub
    both = pairs.join(side("a"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", *(f"{x}_{n}" for x in "ab" for n in ("low", "high", "at", "words")))


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verified passages of pairs of documents: doc_id, first_word, n_words; of_doc_id (less than doc_id), of_first_word; similarity, check (of the words)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield faced_rows(batch.slice(i, 64))

    schema = "doc_id long, first_word long, n_words long, of_doc_id long, of_first_word long, similarity double, check long"
    return shared.materialize(faced(docs, pairs).mapInArrow(run, schema).distinct())


_FOUND = ["doc_id", "first_word", "n_words", "of_doc_id", "of_first_word", "similarity", "check"]


def faced_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    of = lambda n: batch.column(batch.schema.get_field_index(n))
    a, b, a_low, b_low = (of(n).to_numpy() for n in ("a", "b", "a_low", "b_low"))
    sides = []
    for x in "ab":
        runs = [np.frombuffer(w, "<u8")[i - s : j - s] for i, j, s, w in zip(*(of(f"{x}_{n}").to_pylist() for n in ("low", "high", "at", "words")), strict=True)]
        sides += [np.concatenate(runs).astype(np.uint64), np.concatenate(([0], np.cumsum([len(r) for r in runs])))]
    found = passages(*sides)
    p, s, e, s_x, _, sim = (np.array(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
    y, y_at = sides[2:]
    check = shared.run_hashes(y, y_at[p] + s, y_at[p] + e)
    columns = [b[p], b_low[p] + s, e - s, a[p], a_low[p] + s_x, sim.astype(float), shared.signed(check)]
    return shared.arrow(**dict(zip(_FOUND, columns, strict=True)))


def repeats(docs: DataFrame) -> DataFrame:
    """All verified passages (see ``compared``); of texts of the same words, all but one are repeats of that one as wholes."""
    docs = shared.text_of(docs).filter("doc_id is not null")
    rows = shared.materialize(windows(docs))
    copies = classes(rows)
    apart = shared.small(copies.select(F.col("doc_id").alias("doc")))
    rows = shared.materialize(met(rows.filter("n is null").drop("n")).join(apart, "doc", "left_anti"), rows)
    found = copies.select("doc_id", F.lit(0).cast("long").alias("first_word"), "n_words", "of_doc_id", F.lit(0).cast("long").alias("of_first_word"), F.lit(1.0).alias("similarity"), "check")
    new, low_high = paired_at_once(rows), (F.col("low"), F.col("high"))
    here = compared(docs, new)
    found, done, size, turn, parts = found.unionByName(here), new.select("a", "b"), 2, 1, 1
    rows = shared.materialize(uncovered(rows, here, place_of(F.col("at"))), rows)
    keys = signatures(met(rows), size)
    parts_found = [copies, here]
    while not keys.isEmpty():
        pairs, rest = paired(keys, turn, parts)
        new = shared.materialize(pairs.join(done, ["a", "b"], "left_anti"), pairs)
        turn += 1
        if not new.isEmpty():
            here = compared(docs, new)
            parts_found.append(here)
            found, done = found.unionByName(here), done.unionByName(new.select("a", "b"))
            rest = uncovered(rest, here, *low_high)
        rest = shared.materialize(rest, keys)
        if size < HASHES:
            size += 1
            rows = shared.materialize(within(rows, rest), rows)
            keys = signatures(met(rows), size)
        else:
            keys, parts = rest, parts * 16
    return shared.materialize(found, rows, keys, *parts_found)


def cut(docs: DataFrame) -> DataFrame:
    """docs without later occurrences of repeated passages; their own columns, n_chars following the text. Only documents with such passages are joined."""
    found = repeats(docs)
    spans = shared.materialize(found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("first_word", "n_words", "check")).alias("spans")))

    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for batch, raw, bounds in shared.chunks([pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])]):
            starts, ends, at = shared.word_spans(raw, bounds)
            words = shared.word_hashes(raw, bounds)[0]
            own = batch.column(1)
            text = np.repeat(np.arange(batch.num_rows), own.value_lengths().fill_null(0).to_numpy())
            first, n, check = (own.flatten().field(i).to_numpy() for i in range(3))
            ok = np.flatnonzero(first + n <= np.diff(at)[text])
            text, first, n, check = (x[ok] for x in (text, first + at[text], n, check))
            ok = shared.run_hashes(words, first, first + n) == check.view(np.uint64)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, first[ok], 1)
            np.add.at(edge, first[ok] + n[ok], -1)
            gone = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            behind = np.append(starts[1:], len(raw))  # with the white space behind, up to the text's end
            until = np.minimum(behind[gone], bounds[np.searchsorted(at, gone, "right")])
            keep = np.ones(len(raw), bool)
            keep[gather(starts[gone], until - starts[gone])] = False
            to = np.concatenate(([0], np.cumsum(keep)))[bounds]
            data = raw[keep].tobytes()
            out += [data[a:b].decode() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        return pa.array(out, pa.string())

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = row.join(shared.small(spans), F.col("row.doc_id").cast("long") == F.col("id"), "left")
    hit = F.col("spans").isNotNull()
    text = F.when(~hit, F.col("row.text")).otherwise(F.arrow_udf(without, "string")(F.when(hit, F.coalesce(F.col("row.text").cast("string"), F.lit(""))), F.col("spans")))
    out = joined.select("row", "spans", text.alias("text"))
    n_chars = F.when(~hit, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None
    return out.select(*({"text": F.col("text"), "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("check")
