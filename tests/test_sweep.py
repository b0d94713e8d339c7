import random
from itertools import product

import numpy as np

from kvern.operators import measure, rules


def data(spark, n_truth=40):
    rng = random.Random(3)
    preds, edges = [], []
    for i in range(160):
        kilde = ("yolo", "paddle", "begge")[i % 3]
        w, h = rng.uniform(4, 60), rng.uniform(2, 30)
        covered = rng.sample(range(n_truth), rng.choice([0, 0, 1, 1, 2]))
        edges += [(i, f"t{t}", 1.0) for t in covered]
        preds.append((i, 1, kilde, "TREFF" if covered else "BOM", None if kilde == "paddle" else round(rng.random(), 3), w, h, max(w / h, h / w), min(w, h), max(w, h), w * h, w * h * 17.36))
    p = spark.createDataFrame(preds, "pred_id bigint, doc_no bigint, kilde string, klasse string, conf double, w double, h double, elongation double, short_side double, long_side double, area double, areal_px double")
    from pyspark.sql import functions as F

    p = p.withColumns({c: F.lit(None).cast("double") for c in rules.TEXT_FEATURES})
    return p, spark.createDataFrame(edges, "pred_id bigint, label_id string, truth_area double"), spark.createDataFrame([(f"t{t}", 1) for t in range(n_truth)], "label_id string, doc_no bigint"), preds, edges


def plain(preds, edges, removes):
    gone = {p[0] for p in preds if removes(p)}
    coverers = {}
    for i, t, _ in edges:
        coverers.setdefault(t, set()).add(i)
    lost = {t for t, c in coverers.items() if c <= gone}
    critical = {i for i, t, _ in edges if t in lost}
    return len(lost), sum(p[0] in gone and p[3] == "BOM" for p in preds), len(gone), len(critical)


def test_the_sweep_has_the_grids_of_each_source_and_their_product(spark):
    c, e, t, preds, edges = data(spark)
    out, (found, picks) = measure.full_sweep(c, e, t)
    got = {r["config_id"]: r for r in out.collect()}
    assert found == {"begge": True, "paddle": False, "yolo": True}
    assert set(measure.NOISE_AXES) == {"min_short_side", "min_long_side", "max_elongation", "conf_threshold"}
    assert [len(measure.source_grid(f, "yolo", True)) for f in ("geometry", "noise")] == [500, 300] and len(measure.source_grid("noise", "paddle", False)) == 150
    assert len(got) == len(measure.default_sweep(found)) + 2 * 8**3
    shape = ("w", "h", "elongation", "short_side", "long_side", "area", "areal_px")
    rows = {k: np.array([p[4] if p[4] is not None else np.nan for p in preds]) if k == "conf" else np.array([p[5 + shape.index(k)] for p in preds]) if k in shape else np.full(len(preds), np.nan) for k in rules.INPUTS}
    removed = {(f, k, i): rules.removed_rows(rows, rules.validated(config)) & np.array([p[2] == k for p in preds]) for f, of in picks.items() for k, p_ in of.items() for i, (_, _, config) in enumerate(p_)}
    for family, of in picks.items():
        for k, candidates in of.items():
            nets = sorted((-got[i]["net"], got[i]["lost"]) for i in {i for i, _, _ in candidates})
            assert len(candidates) == 8 and nets[-1] <= min([(-r["net"], r["lost"]) for i, r in got.items() if i.startswith(f"{family} [{k}]") and i not in {i for i, _, _ in candidates}])
        for at in product(range(8), repeat=3):
            gone = np.logical_or.reduce([removed[family, k, i] for k, i in zip(of, at)])
            r = got[f"cross {family} " + "; ".join(f"{k} {of[k][i][1]}" for k, i in zip(of, at))]
            lost, ov, n, critical = plain(preds, edges, lambda p: gone[p[0]])
            assert (r["lost"], r["ov_rm"], r["n_rm"], r["critical_rm"], r["red_rm"], r["net"]) == (lost, ov, n, critical, n - ov - critical, ov - 5.0 * lost)
    again = measure.full_sweep(c, e, t, (found, picks))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))
