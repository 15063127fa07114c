import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fareframe.operators import order_stats as O


def frame(spark, values, name="v"):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in values], f"{name} double")


def check(spark, values, ps):
    got = {r["p"]: r["value"] for r in O.quantiles(frame(spark, values), "v", ps).collect()}
    present = [v for v in values if v is not None]
    assert set(got) == set(map(float, ps))
    for p in ps:
        assert got[p] == pytest.approx(np.quantile(present, p), rel=1e-12, abs=1e-12), p


PS = [0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995, 1.0]


@pytest.mark.parametrize(
    "values",
    [list(range(100)), [7.0] * 50, [3.5], [1, None, 2, None], [1, 1, 1, 5, 9, 9], [-1e9, 0.0, 1e9]],
)
def test_quantiles_small(spark, values):
    check(spark, values, PS)


def test_quantiles_all_null(spark):
    assert O.quantiles(frame(spark, [None, None]), "v", [0.5]).collect() == []
    assert O.quantile_values(frame(spark, [None]), "v", [0.5]) == {}


def test_quantiles_hot_value_and_order(spark):
    rng = random.Random(1)
    values = [42.0] * 4000 + [rng.lognormvariate(0, 2) for _ in range(8000)]
    rng.shuffle(values)
    check(spark, values, PS)
    df = frame(spark, values)
    again = O.quantiles(df.repartition(7), "v", PS).orderBy("p").collect()
    assert again == O.quantiles(df, "v", PS).orderBy("p").collect()


def test_quantiles_with_coarse_cells(spark, monkeypatch):
    """Few cells and parts, so that every rank needs the second pass and a running sum within a part."""
    monkeypatch.setattr(O, "CELLS", 0.2)
    monkeypatch.setattr(O, "PARTS", 3)
    rng = random.Random(2)
    check(spark, [rng.gauss(0, 1) for _ in range(30000)], PS)
    values = [rng.choice([0.0, -0.0, 1e-9, 5e-324, 1e300, -1e300, 2.5, 2.5000000001]) for _ in range(2000)]
    check(spark, values, PS)
    got = O.ecdf(frame(spark, values), "v").orderBy("value").collect()
    assert [r["upto"] for r in got] == np.cumsum([r["n"] for r in got]).tolist() and got[-1]["y"] == 1.0


def test_quantiles_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.lognormvariate(0, 3)) for _ in range(4000)] + [("one", 7.0), ("empty", None)]
    got = {(r["g"], r["p"]): r["value"] for r in O.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", PS, by=["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", None, "one"}
    for (g, p), value in got.items():
        assert value == pytest.approx(np.quantile([v for k, v in rows if k == g], p), rel=1e-12)


def test_quantile_plan_has_no_nested_loop(spark):
    plan = O.quantiles(frame(spark, [1.0, 2.0, 3.0]), "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_quantiles_property(spark, values):
    check(spark, values, [0.0, 0.1, 0.33, 0.5, 0.9, 1.0])


def test_quantiles_reject_bad_probability(spark):
    with pytest.raises(ValueError):
        O.quantiles(frame(spark, [1]), "v", [1.5])


@pytest.mark.parametrize("cells", [0.5, 512])
def test_ecdf(spark, monkeypatch, cells):
    monkeypatch.setattr(O, "CELLS", cells)
    rng = random.Random(3)
    values = [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(5000)] + [None]
    got = O.ecdf(frame(spark, values), "v").orderBy("value").toPandas()
    counts = pd.Series([v for v in values if v is not None]).value_counts().sort_index()
    assert got["value"].tolist() == counts.index.tolist()
    assert got["n"].tolist() == counts.tolist()
    assert got["upto"].tolist() == counts.cumsum().tolist()
    assert got["y"].iloc[-1] == 1.0


def test_histogram_matches_numpy(spark):
    values = [0.0, 1.0, 2.5, 9.99, 10.0, 10.0]
    got = {r["bin"]: r["n"] for r in O.histogram(frame(spark, values), "v", 4).collect()}
    want, _ = np.histogram(values, bins=4)
    assert [got.get(i, 0) for i in range(4)] == want.tolist()
    assert [(r["bin"], r["n"]) for r in O.histogram(frame(spark, [5.0, 5.0]), "v", 4).collect()] == [(0, 2)]


def test_log_tail_histogram_covers_the_tail(spark):
    values = [math.exp(i / 100) for i in range(1000)]
    got = O.log_tail_histogram(frame(spark, values), "v", 0.9, bins=10).orderBy("bin").collect()
    cut = np.quantile(values, 0.9)
    assert sum(r["n"] for r in got) == sum(v >= cut for v in values)
    assert got[0]["bin_lo"] == pytest.approx(cut)
    assert got[-1]["bin_hi"] == pytest.approx(max(values))


def test_equal_width_cut_matches_pandas(spark):
    values = [1.0, 2.0, 3.0, 3.7, 4.2, 5.0, 6.0]
    labels = list("abcde")
    got = [r["x"] for r in O.equal_width_cut(frame(spark, values), "v", labels, "x").orderBy("v").collect()]
    assert got == pd.cut(pd.Series(values), bins=5, labels=labels).tolist()


def test_capped_bins(spark):
    values = [float(i) for i in range(1, 101)] + [5000.0, -3.0, None]
    got = O.capped_bins(frame(spark, values), "v").toPandas()
    valid = np.array([v for v in values if v is not None and v > 0])
    cap, far = np.quantile(valid, [0.95, 0.99])
    capped = np.minimum(valid, cap)
    edges = sorted(set(np.quantile(capped, [0, 0.2, 0.4, 0.6, 0.8, 1.0])))
    edges[0] -= 0.01
    edges[-1] += 0.01
    assert len(got) == len(valid)
    for row in got.itertuples():
        assert row.capped == pytest.approx(min(row.v, cap))
        assert row.bin == sum(e <= row.capped for e in edges)
        assert row.is_outlier == int(row.v > far)
    same = O.capped_bins(frame(spark, [2.0, 2.0]), "v").collect()
    assert [r["bin"] for r in same] == [2, 2]


def test_probability_labels():
    assert [O.probability_label(p) for p in (0.01, 0.5, 0.995)] == ["p1", "p50", "p99.5"]


def test_quantile_struct(spark):
    df = spark.createDataFrame([(i, float(-i)) for i in range(11)], "a int, b double")
    got = df.limit(1).select(O.quantile_struct(df, {"x": ("a", 0.5), "y": ("b", 0.1)}).alias("q")).first()["q"]
    assert (got["x"], got["y"]) == (5.0, -9.0)
    assert df.select(F.lit(1)).count() == 11
