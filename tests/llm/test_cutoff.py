import math
import random

from kvern.llm import cutoff

SCHEMA = "pred_id bigint, kilde string, yolo_conf double, paddle_rec_score double, part string, n string"
TARGETS = "kilde string, poengfelt string, maal_andel double"


def brute(rows, targets):
    kept = set()
    for kilde, field, share in targets:
        scores = {}
        for pred, k, y, p, *_ in rows:
            s = y if field == "yolo_conf" else p
            if pred is not None and k is not None and k.strip().lower() == kilde and s is not None and not math.isnan(s) and 0 <= s <= 1:
                scores[pred] = max(s, scores.get(pred, 0))
        for c in sorted(set(scores.values()), reverse=True):
            if sum(v >= c for v in scores.values()) >= share * len(scores):
                kept |= {p for p, v in scores.items() if v >= c}
                break
    return kept


def test_kept_records_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        kilde = rng.choice(["yolo", " YOLO ", "Begge", "paddle", None, "", "annen"])
        score = rng.choice([None, float("nan"), -1.0, 98.5, 0.5, 0.5, 0.5, round(rng.random(), 2), 0.0, 1.0])
        rows.append((i, kilde, score, round(rng.random(), 3), "x", "y"))
    rows += rows[:100] + [(None, "yolo", 0.4, 0.4, None, None)]
    targets = [("yolo", "yolo_conf", 0.85), ("begge", "yolo_conf", 0.5), ("paddle", "paddle_rec_score", 1.0)]
    data = spark.createDataFrame(rows, SCHEMA)
    got = {r[0] for r in cutoff.kept_records(data, spark.createDataFrame(targets, TARGETS)).collect()}
    assert got == brute(rows, targets)


def test_empty_and_odd_targets(spark):
    data = spark.createDataFrame([(1, "yolo", 0.3, None, "", ""), (2, "yolo", 0.7, None, "", "")], SCHEMA)
    odd = spark.createDataFrame([("yolo", "yolo_conf", 0.0), ("yolo", "yolo_conf", 1.5), ("ukjent", "yolo_conf", 0.5), (None, None, None), ("yolo", "finnes_ikke", 0.5)], TARGETS)
    got = {(r["kilde"], r["maal_andel"]): (r["cutoff"], r["n_kept"]) for r in cutoff.cutoffs(data, odd)[0].collect() if r["poengfelt"] == "yolo_conf"}
    assert got == {("yolo", 0.0): (0.7, 1), ("yolo", 1.5): (None, 0), ("ukjent", 0.5): (None, 0)}
    assert cutoff.kept_records(data.limit(0), odd).count() == 0
    assert cutoff.kept_records(data, odd.limit(0)).count() == 0


def test_one_hot_score(spark):
    rows = [(i, "yolo", 0.5, None, "", "") for i in range(300)] + [(1000 + i, "yolo", 0.9, None, "", "") for i in range(10)]
    one = spark.createDataFrame([("yolo", "yolo_conf", 0.1)], TARGETS)
    r = cutoff.cutoffs(spark.createDataFrame(rows, SCHEMA), one)[0].first()
    assert (r["cutoff"], r["n_kept"], r["n_scored"]) == (0.5, 310, 310)
