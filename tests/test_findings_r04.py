"""Cases of the findings of round 4: memory of full slabs of vectors, odd prices against the queries' SQL."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import hard_negatives
from tests.test_findings_r03 import both


class Task:
    """Stands for the rows' DataFrame and keeps the function that its tasks run."""

    def __init__(self, spark):
        self.spark = spark

    def mapInArrow(self, f, schema):
        self.run = f
        return self.spark.createDataFrame([], schema)


def slab_of(rng, n, d):
    """A table of n coded rows of three labels, and their integers."""
    v = np.floor(256 * rng.standard_normal((n, d)) / np.sqrt(d))
    turn = hard_negatives.rotations(d)
    bits, norm, alignment = hard_negatives.code(v, turn)
    blobs = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    return pa.table({"vec_id": np.arange(n), "label": (np.arange(n) % 3).astype(np.int32), "ints": blobs(v.astype("<i4")), "code": blobs(bits), "norm": norm, "alignment": alignment}), v


@pytest.mark.parametrize("kind", ["positives", "negatives"])
def test_a_full_slab_takes_little_memory(spark, monkeypatch, kind):
    """65,536 rows of 64 components and 256 anchors in one task: under 150 MB, and the best rows of each anchor."""
    n, d, k = 1 << 16, 64, 5
    table, v = slab_of(np.random.default_rng(4), n, d)
    anchors = table.select(["vec_id", "label", "ints"]).slice(0, 256)
    exact = v[:256] @ v.T
    labels = np.arange(n) % 3
    same = (labels[None, :] == labels[:256, None]) & (np.arange(n)[None, :] != np.arange(256)[:, None])
    first = lambda s: np.lexsort((np.arange(n), -s))[:k]
    want = {(i, r, int(exact[i, r])) for i in range(256) for r in first(np.where(same[i], exact[i], -np.inf))}
    if kind == "negatives":
        best = [max(s for i, _, s in want if i == a) for a in range(256)]
        anchors = anchors.append_column("positive_scores", pa.array([[b] for b in best]))
        band = (labels[None, :] != labels[:256, None]) & (100 * exact >= 80 * np.array(best)[:, None]) & (exact <= np.array(best)[:, None])
        want = {(i, r, int(exact[i, r])) for i in range(256) for r in first(np.where(band[i], exact[i], -np.inf)) if band[i, r]}
    monkeypatch.setattr(hard_negatives, "_anchor_files", lambda anchors: ("", []))
    monkeypatch.setattr(hard_negatives, "_blocks", lambda uri, parts, d: iter([(anchors, v[:256])]))
    task = Task(spark)
    hard_negatives.positives(task, d, None, k) if kind == "positives" else hard_negatives.negatives(task, d, None, k, 80, 100)
    tracemalloc.start()
    out = list(task.run(table.to_batches(max_chunksize=1000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches(out).to_pydict()
    found = "positive_id" if kind == "positives" else "negative_id"
    assert set(zip(got["anchor_id"], got[found], got["score"])) == want
    assert peak < 150e6


def test_negatives_of_empty_vectors(spark):
    rows = spark.createDataFrame([(i, i % 2, []) for i in range(4)], "vec_id long, label int, embedding array<float>")
    got = hard_negatives.mine(rows, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 2, 1, 1, 0, 0), (0, 2, 2, 3, 0, 0)]


def odd(*prices: str, rest: str = "value") -> str:
    """Events of sf0.001 with odd prices on every third day, one kind a group of users, and ``rest`` on the other days."""
    kinds = " ".join(f"when user_id % {len(prices)} = {i} then {p}::double" for i, p in enumerate(prices))
    return f"select * replace (case when day(ts) % 3 <> 1 then {rest} else case {kinds} end end as value) from events_given"


def written(rows: Counter) -> Counter:
    """Rows as text, so that NaN is itself and a negative zero is no other."""
    return Counter(tuple(map(repr, r)) for r in rows.elements())


def test_position_size_query_with_odd_prices(spark, tmp_path):
    """Prices of 0, -0.0, next to 0 (more shares than a whole number of 64 bits) and NaN, and negative ones."""
    got, sql = both(spark, tmp_path, "D10_position_size", events=odd("0.0", "'-0.0'", "1e-20", "'nan'", "-3.5"))
    assert written(got) == written(sql) and {"inf", "nan", "2.0000000000000002e+23"} <= {r[2] for r in written(got)}


def test_excursion_query_with_odd_prices(spark, tmp_path):
    """Prices of 0 and -0.0, and returns that lie between two roundings (9.63 over 6.40 is 1.5046875)."""
    tie = "case when user_id % 5 in (2, 3) then 9.63 else value end"
    got, sql = both(spark, tmp_path, "F8_mfe_mae", events=odd("0.0", "'-0.0'", "6.4", "6.4", "-3.5", rest=tie))
    assert written(got) == written(sql) and {"inf", "nan"} & {x for r in written(got) for x in r} and {"0.504687", "-0.504687"} <= {x for r in written(got) for x in r}


def test_excursion_query_with_ids_of_two_months(spark, tmp_path):
    """Order ids hold the day of the month alone: an id of two months is one trade."""
    months = "select * replace (ts + to_days(31 * (event_id % 2)::int) as ts) from events_given"
    got, sql = both(spark, tmp_path, "F8_mfe_mae", events=months)
    assert written(got) == written(sql) and len(got) > 100


def test_panel_query_with_odd_prices(spark, tmp_path):
    """Positions opened at 0 and -0.0, and returns of shorts at their own price, which are negative zeros."""
    got, sql = both(spark, tmp_path, "G0_position_bar_panel", events=odd("0.0", "'-0.0'", "6.4", "6.4", "-3.5", rest="case when user_id % 5 in (2, 3) then 6.4 else value end"))
    assert written(got) == written(sql) and {"-0.0", "0.0", "inf", "-inf"} <= {r[2] for r in written(got)}
