import random

import pytest
from pyspark.sql import functions as F

from kvern.operators import layout, review
from tests.test_functions import made_number
from tests.test_operators import BOXES, frame, token


def test_box_features(spark):
    n = made_number(random.Random(12))
    first = [token(n, 100, 100), token("Fjell", 500, 100, 1, rec=0.8), token("borettslag", 100, 160, 2), token("12.5", 100, 400, 3), token("00987654321", 300, 400, 4)]
    tokens = frame(spark, first, [token("00987654321", 300, 400)], [token("1.2.3", 100, 100)])
    boxes = [(1, 1, 0, 100.0, 100.0, 408.0, 150.0), (1, 1, 1, 100.0, 400.0, 212.0, 450.0), (1, 1, 2, 300.0, 400.0, 608.0, 450.0), (1, 2, 0, 300.0, 400.0, 608.0, 450.0), (1, 3, 0, 156.0, 100.0, 184.0, 150.0), (1, 3, 1, 212.0, 100.0, 240.0, 150.0), (9, 1, 0, 0.0, 0.0, 10.0, 10.0)]
    got = {(r["doc"], r["page"], r["ord"]): r for r in layout.box_features(tokens, spark.createDataFrame([(*b, 0.5) for b in boxes], BOXES)).collect()}
    assert len(got) == len(boxes)
    f = got[1, 1, 0]
    assert (f["har_tokens"], f["n_siffer"], f["n_bokstaver"], f["siffer_run"], f["lang_run"], f["har_fnr_kandidat"], f["har_org_ord"]) == (1, 11, 0, 11, 11, 1, 1)
    assert f["rec_min"] == 0.99 and f["rec_min_linje"] == 0.8 and f["n_siffer_linje"] == 11
    f = got[1, 1, 1]
    assert f["har_desimal_naer"] == 1 and f["har_fnr_kandidat"] == 1  # 5.0098... begins with the day of a D-number and a month
    f = got[1, 1, 2]
    assert f["har_00_run"] == 0 and f["har_org_ord"] == 0  # the separator joins both tokens into one longer run
    assert got[1, 2, 0]["har_00_run"] == 1
    assert (got[1, 3, 0]["har_desimal_naer"], got[1, 3, 1]["har_desimal_naer"]) == (1, 0)  # 2.3 overlaps 1.2, which is taken first
    f = got[9, 1, 0]
    assert f["har_tokens"] == 0 and f["rec_min"] is None and f["lang_run"] == 0


def test_diff_additions(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n same\n+new\n-old\n+two\n@@ -9,1 +10,2 @@\n ctx\n+ten\n+++ b/y.txt\n@@ -0,0 +1 @@\n+only"
    lines = spark.createDataFrame([("d", i, v) for i, v in enumerate(text.split("\n"))], "diff string, pos int, value string")
    got = sorted((r["file"], r["line"], r["text"]) for r in review.diff_additions(lines).collect())
    assert got == [("x", 2, "new"), ("x", 3, "two"), ("x", 11, "ten"), ("y.txt", 1, "only")]


def test_specs_and_yaml():
    assert review.per_source_spec("YOLO: min_digits=5, rec_veto=0.98; paddle:max_gap=6") == {"yolo": {"min_digits": 5.0, "rec_veto": 0.98}, "paddle": {"max_gap": 6.0}}
    with pytest.raises(TypeError):
        review.per_source_spec("yolo:finnes_ikke=1")
    with pytest.raises(ValueError):
        review.per_source_spec("yolo")
    assert review.flat_yaml("a: 1\nb: 2.5 # note\nc:\n  d: true\n  e: x\nf: ~\n# skip\n") == {"a": 1, "b": 2.5, "c": {"d": True, "e": "x"}, "f": None}


def test_small_tables(spark):
    held = spark.createDataFrame([("a", ["x"])], "label_id string, replaced_by array<string>")
    assert [review.extended_retraction(held, *a) for a in (("b", []), ("a", ["x"]), ("a", ["y"]))] == ["new", "unchanged", "extended"]
    stored = spark.createDataFrame([(1, "BOM"), (2, "TREFF")], "nr bigint, klasse string")
    newer = spark.createDataFrame([(1, "TREFF")], "nr bigint, klasse string")
    assert sorted(map(tuple, review.synced_classes(stored, newer).collect())) == [(1, "TREFF"), (2, "TREFF")]
    epochs = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.6)], "epoch int, m double")
    assert review.best_epoch(epochs, "m").first()["epoch"] == 2
    log = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, t double")
    assert sorted(map(tuple, review.last_step(log, "k", "t").collect())) == [("a", 3.0), ("b", 2.0)]
    names = spark.createDataFrame([("skann/12_side3.png",), ("0012_p4.PNG",), ("12.pdf",), (None,)], "n string").select(review.name_parts(F.col("n")).alias("k")).collect()
    assert [(r["k"]["doc"], r["k"]["page"]) for r in names] == [(12, 3), (12, 4), (12, None), (None, None)]


def test_numbering_is_total(spark):
    rows = [(i, f"{100 + i % 17}.pdf", i % 3, float(i % 5), float(i % 7), "yolo") for i in range(400)]
    df = spark.createDataFrame(rows, "pred_id bigint, navn string, side int, y0 double, x0 double, kilde string")
    want = {p: k + 1 for k, (n, s, y, x, src, p) in enumerate(sorted((n, s, y, x, src, p) for p, n, s, y, x, src in rows))}
    assert {r[0]: r[1] for r in review.numbered(df.repartition(5)).collect()} == want
