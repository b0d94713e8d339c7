import random

import numpy as np

from kvern.llm import digest

SCHEMA = "type string, width string, height string, lastet timestamp, dag string, value string"


def one(v, w, delta):
    return digest.clustered(np.zeros(len(v), np.int64), v, w, delta)[1:]


def test_cluster_keeps_mass_and_bounds_size():
    rng = np.random.default_rng(1)
    v = rng.lognormal(3, 1, 50_000)
    m, w = one(v, np.ones(len(v)), 200)
    assert w.sum() == len(v) and len(m) <= 220 and np.all(np.diff(m) >= 0)
    for q in (0.001, 0.1, 0.5, 0.9, 0.999):
        got = digest.quantile(m, w, v.min(), v.max(), q)
        assert abs((v < got).mean() - q) < 0.005
    parts = [one(p, np.ones(len(p)), 200) for p in np.array_split(v, 7)]
    m, w = one(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), 200)
    assert abs((v < digest.quantile(m, w, v.min(), v.max(), 0.5)).mean() - 0.5) < 0.01


def test_groups_are_clustered_apart():
    rng = np.random.default_rng(2)
    group, v = rng.integers(0, 5, 3000), rng.normal(size=3000)
    g, m, w = digest.clustered(group, v, np.ones(3000), 100)
    for i in range(5):
        a, b = one(v[group == i], np.ones((group == i).sum()), 100)
        assert np.allclose(m[g == i], a) and np.allclose(w[g == i], b)


def test_small_groups_give_their_own_values():
    m, w = one(np.array([3.0, 1.0, 2.0]), np.ones(3), 400)
    assert [digest.quantile(m, w, 1.0, 3.0, q) for q in (0.01, 0.5, 0.99)] == [1.0, 2.0, 3.0]


def test_a_small_buffer_gives_the_same_counts(spark, monkeypatch):
    rows = [(f"T{i % 50}", f"{i % 977}.5", "1", None, "", "") for i in range(20_000)]
    values = digest.sizes(spark.createDataFrame(rows, SCHEMA))
    big = {(r["type"], r["felt"]): (r["n"], r["low"], r["high"]) for r in digest.day_digests(values, ["type", "felt", "dag"]).collect()}
    monkeypatch.setattr(digest._Pool.__init__, "__defaults__", (500,))
    small = {(r["type"], r["felt"]): (r["n"], r["low"], r["high"]) for r in digest.day_digests(values, ["type", "felt", "dag"]).collect()}
    assert big == small and len(big) == 100 and sum(n for n, _, _ in big.values()) == 40_000


def test_a_coarse_digest_is_refined_until_certified(spark):
    rng = random.Random(8)
    rows = [("FNR", f"{rng.lognormvariate(3, 2):.4f}", "1", None, "", "") for _ in range(5000)]
    out = digest.percentiles(spark.createDataFrame(rows, SCHEMA), delta=6).collect()
    assert len(out) == 14 and all(r["within"] for r in out)


def test_percentiles_are_certified(spark):
    from datetime import datetime

    rng = random.Random(5)
    rows = []
    for i in range(4000):
        kind = rng.choice(["FNR", " fnr", "DNR", None])
        rows.append((kind, rng.choice([f"{rng.lognormvariate(3, 1):.2f}", f"-{rng.lognormvariate(3, 1):.2f}", "7,50", "NaN", "", None, "0"]), "12.0", datetime(2026, 1, 1 + i % 5) if i % 9 else None, "", ""))
    out = digest.percentiles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["type"] for r in out} == {"FNR", "DNR", "(none)"}
    assert all(r["within"] for r in out)
    assert all(r["value"] == 12.0 and r["rank_error"] == 0 for r in out if r["felt"] == "height")


def test_days_combine(spark):
    rows = [("FNR", f"{i}", "1", None, "", "") for i in range(1, 1001)]
    values = digest.sizes(spark.createDataFrame(rows, SCHEMA))
    days = digest.day_digests(values, ["type", "felt", "dag"])
    both = digest.combined(days.union(days), ["type", "felt"])
    got = {r["felt"]: (r["n"], r["estimates"]) for r in digest.estimates(both, ["type", "felt"], (0.5,)).collect()}
    assert got["width"][0] == 2000 and abs(got["width"][1][0] - 500) < 6
    assert digest.percentiles(spark.createDataFrame([], SCHEMA)).count() == 0
