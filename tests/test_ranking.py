import random
from bisect import bisect_left

import pytest

from kvern.operators import matching


def boxes(spark, preds, edges, n_truth):
    p = spark.createDataFrame([(i, klasse, conf) for i, (klasse, conf) in enumerate(preds)], "pred_id bigint, klasse string, conf double")
    return p, spark.createDataFrame(edges, "pred_id bigint, label_id string"), spark.createDataFrame([(f"t{i}",) for i in range(n_truth)], "label_id string")


@pytest.mark.parametrize("n", [60, 1500])
def test_cuts_as_in_the_ranking_script(spark, n):
    rng = random.Random(n)
    preds = [("TREFF" if i % 3 else "BOM", None if i % 7 == 0 else rng.random()) for i in range(n)]
    edges = [(i, f"t{rng.randrange(n)}") for i in range(n) if i % 3]
    conf = [1.0 if c is None else c for _, c in preds]
    top = {}
    for i, t in edges:
        top[t] = max(top.get(t, -1.0), conf[i])
    covered = sorted(top.get(f"t{i}", -1.0) for i in range(n))
    bom = sorted(c for c, (k, _) in zip(conf, preds) if k == "BOM")
    points = sorted({round(v, 4) for v in covered + bom if v >= 0} | {0.5})
    if len(points) > 400:
        step = len(points) / 400
        points = sorted({points[int(i * step)] for i in range(400)} | {0.5})
    want = {c: (bisect_left(covered, c), len(bom) - bisect_left(bom, c)) for c in points}
    got = {r["conf"]: (r["miss"], r["over"]) for r in matching.confidence_points(*boxes(spark, preds, edges, n)).collect()}
    assert got == want


def test_slices(spark):
    p, e, _ = boxes(spark, [("TREFF", 0.3), ("TREFF", None), ("TREFF", 0.9)], [(0, "a"), (1, "b"), (2, "c")], 0)
    t = spark.createDataFrame([("a", 1, True, "MOVED"), ("b", 1, True, "ACCEPTED"), ("c", 2, False, ""), ("d", 3, True, "")], "label_id string, doc_no bigint, ml boolean, status string")
    meta = spark.createDataFrame([(1, 1980, ["X", "Y"]), (2, None, [])], "doc_no bigint, decade int, codes array<string>")
    cuts = spark.createDataFrame([("standard", 0.5)], "cut string, conf double")
    got = {(r["part"], r["value"]): (r["n_truth"], r["miss"], r["worst"]) for r in matching.cut_slices(p, e, t, meta, cuts).collect()}
    assert got == {("manual", "manual"): (2, 1, False), ("decade", "1980"): (2, 1, True), ("decade", "unknown"): (2, 1, False), ("code", "X"): (2, 1, True), ("code", "Y"): (2, 1, False), ("code", "unknown"): (2, 1, False)}
