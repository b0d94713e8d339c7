"""Answers and their cache, pages beside labels, data sets, joins on hot keys, files: worked cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kvern.functions import geometry as g
from kvern.operators import answers, dataset, offpage, review, sampling, stats
from kvern.session import join_hot, materialize, scratch
from kvern.sources import files
from kvern.streaming import queue

LABELS = "label_id string, doc_no bigint, side int, x0 double, y0 double, x1 double, y1 double, ml boolean, status string"


def test_answer_cache(spark):
    assert answers.fingerprint(a=1, b="x") == answers.fingerprint(b="x", a=1) != answers.fingerprint(a=2, b="x")
    items = spark.createDataFrame([(1, "img", "tekst"), (2, "img", None), (3, None, None), (4, None, 'a"b\\c\nd')], "nr bigint, i string, o string").withColumn("key", answers.item_key(F.col("i"), F.col("o")))
    keys = {r["nr"]: r["key"] for r in items.collect()}
    assert keys[3] is None and len({keys[1], keys[2], keys[4]}) == 3 and all(len(keys[k]) == 24 for k in (1, 2, 4))
    import hashlib
    import json

    assert keys[4] == hashlib.sha256(json.dumps('a"b\\c\nd').encode()).hexdigest()[:24]
    cache = spark.createDataFrame([(keys[1], 1, '{"svar": "nei"}'), (keys[2], 1, "Nei."), (keys[4], 2, '{"svar": "nei"}'), (keys[4], 1, "  "), (None, 1, "x")], "key string, version int, raw string")
    got = {r["nr"]: (r["svar"], r["note"]) for r in answers.looked_up(items, cache).collect()}
    assert got == {1: ("nei", "hit"), 2: ("ja", "answer was not JSON"), 3: ("ja", "miss"), 4: ("ja", "miss")}
    new = spark.createDataFrame([("a", '{"svar": "ja"}'), ("a", '{"svar": "ja"}'), ("b", "uleselig"), (None, '{"svar": "ja"}'), ("c", None)], "key string, raw string")
    assert [r["key"] for r in answers.to_store(new).collect()] == ["a"]


def test_counters_and_errors(spark):
    rows = spark.createDataFrame([("yolo", "hit", True), ("yolo", "call failed", False), ("paddle", "written", False), ("yolo", "breaker open", False)], "kilde string, note string, dropped boolean")
    got = {r["kilde"]: (r["judged"], r["dropped"], r["hits"], r["not_cached"]) for r in answers.counters(rows).collect()}
    assert got == {"yolo": (3, 1, 1, "breaker open=1;call failed=1"), "paddle": (1, 0, 0, ""), "SUM": (4, 1, 1, "breaker open=1;call failed=1")}
    said = spark.createDataFrame([("x\n y Error Message Summary: -- ResourceExhausted  now --",), ("plain",), (None,)], "e string")
    assert [tuple(r) for r in said.select(answers.short_error(F.col("e")), answers.is_memory_error(F.col("e"))).collect()] == [("ResourceExhausted now", True), ("plain", False), (None, None)]


def test_pages_beside_labels(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 600.0, 800.0, 0.0, 0.0, 600.0, 800.0, 600.0, 800.0), (1, 2, 90, 600.0, 800.0, 5.0, 0.0, 590.0, 800.0, 800.0, 590.0), (2, 1, 0, 600.0, 800.0, 0.5, 0.0, 599.5, 800.0, 600.0, 800.0)], "doc_no bigint, side int, rotate int, mw double, mh double, cx double, cy double, cw double, ch double, vw double, vh double")
    got = {r["what"]: (r["n"], r["share"]) for r in offpage.page_census(boxes).collect()}
    assert got == {"rotate 0": (2, 0.666667), "rotate 90": (1, 0.333333), "pages with crop box": (1, 0.333333), "documents turned": (1, 0.5), "documents with crop box": (1, 0.5)}
    labels = spark.createDataFrame([("a", 1, 1, 10.0, 10.0, 50.0, 20.0, True, ""), ("b", 1, 2, 650.0, 100.0, 700.0, 110.0, True, "MOVED"), ("c", 9, 1, 0.0, 0.0, 1.0, 1.0, False, "")], LABELS)
    got = {tuple(r) for r in offpage.placement_census(labels, boxes).collect()}
    assert got == {("rotate 0", "ML unprocessed", "inside", "inside", 1), ("rotate 90 + cropbox", "ML", "outside", "inside", 1), ("none", "manual", "no such page", "", 1)}


def test_uncovered_numbers(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_no bigint, side int, pw double, ph double")
    px = g.PX_PER_PT
    box = lambda x0, y0, x1, y1: [v * px for v in (x0, y0, x1, y1)]
    rows = [(1, 1, *box(100, 100, 200, 110), *box(150, 100, 200, 110), 11, True), (1, 1, *box(100, 300, 200, 310), *box(150, 300, 200, 310), 11, False)]
    c = spark.createDataFrame(rows, "doc bigint, page int, x0 double, y0 double, x1 double, y1 double, rx0 double, ry0 double, rx1 double, ry1 double, n_digits int, mod11 boolean")
    labels = spark.createDataFrame([("in", 1, 1, 140.0, 95.0, 210.0, 115.0, False, ""), ("off", 1, 1, 650.0, 300.0, 700.0, 310.0, False, ""), ("far", 1, 1, 650.0, 500.0, 700.0, 510.0, True, "REJECTED"), ("part", 1, 1, 580.0, 101.0, 640.0, 109.0, True, "REJECTED")], LABELS)
    found = materialize(offpage.covered_candidates(c, labels, pages))
    assert {round(r["y0"]): r["cover"] for r in found.collect()} == {100: 1.0, 300: 0.0}
    got = {r["label_id"]: (r["kind"], r["verdict"]) for r in offpage.off_page_verdicts(labels, found, pages).collect()}
    assert got == {"off": ("outside", "UNCOVERED fnr on this line"), "far": ("outside", "no candidate on this line"), "part": ("partial", "line candidates all covered")}


def test_negatives_are_taken_in_turn(spark):
    positives = spark.createDataFrame([(i, 10, "train" if i < 8 else "val" if i == 8 else "test") for i in range(10)], "doc_no bigint, pages bigint, split string")
    negatives = spark.createDataFrame([(100 + i, 3) for i in range(20)], "doc_no bigint, pages bigint")
    out = dataset.with_negatives(positives, negatives, "pages").where("doc_no >= 100").groupBy("split").agg(F.sum("weight").alias("w")).collect()
    assert {r["split"]: r["w"] for r in out} == {"train": 9, "val": 3, "test": 3}
    assert dataset.with_negatives(positives, negatives.limit(0), "pages").count() == 10
    assert dataset.with_negatives(positives.limit(0), negatives, "pages").count() == 0


def test_holdout_pools(spark):
    meta = spark.createDataFrame([(i, 1900 + 10 * (i % 3) if i % 7 else None) for i in range(200)], "doc_no bigint, decade int")
    labelled = spark.createDataFrame([(i,) for i in range(0, 120)] + [(999,)], "doc_no bigint")
    pools = {}
    for r in dataset.holdout_pools(labelled, meta, 0.25, 10, 20, spark.createDataFrame([(3,), (4,)], "doc_no bigint")).collect():
        assert r["doc_no"] not in pools
        pools[r["doc_no"]] = r["pool"]
    count = lambda p: sum(v == p for v in pools.values())
    assert pools[3] == pools[4] == "train" and 999 not in pools and abs(count("holdout") - 0.25 * 118) <= 3 and count("holdout") + count("train") == 120
    assert abs(count("holdout negative") - 10) <= 2 and abs(count("train negative") - 20) <= 3


def test_batch_size_log(spark):
    log = [True, False, True, True, True, True, True, True, True, True, True, False, True]
    got = [r["size"] for r in queue.batch_sizes(spark.createDataFrame([("w", i, ok) for i, ok in enumerate(log)], "worker string, order int, ok boolean")).orderBy("order").collect()]
    assert got[:3] == [12, 12, 6] and got[7] == 6 and got[8] == 7 and got[-1] == got[-2] // 2


def test_joins_on_hot_keys(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 3000), i) for i in range(4000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "key bigint, i int")
    keyed = left.where("key is not null and key % 2 = 1").groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max("key") * 10).alias("v"))
    got = sorted(map(tuple, join_hot(left, keyed, "key", "n").collect()))
    assert got == sorted((k, i, k * 10) for k, i in rows if k is not None and k % 2 == 1)


def test_scratch_removes_its_tables(spark, tmp_path):
    with scratch():
        df = materialize(spark.range(3))
        path = df._kvern_path
        assert df.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_percentiles_of_hot_groups(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([1.0, 2.0, rng.random()])) for _ in range(500)] + [("b", 7.0), ("c", None)]
    got = {(r["k"], r["q"]): r["value"] for r in stats.linear_percentiles(spark.createDataFrame(rows, "k string, value double"), ["k"], (0.0, 0.3, 0.5, 1.0)).collect()}
    v = sorted(x for k, x in rows if k == "a")
    at = lambda q: v[math.floor(499 * q)] + (v[math.ceil(499 * q)] - v[math.floor(499 * q)]) * (499 * q - math.floor(499 * q))
    assert all(abs(got["a", q] - at(q)) < 1e-9 and got["b", q] == 7.0 for q in (0.0, 0.3, 0.5, 1.0)) and len(got) == 8


def test_capped_groups(spark):
    docs = spark.createDataFrame([(i, "x" if i % 3 else None, 1 + i % 4) for i in range(60)], "doc_no bigint, g string, w bigint")
    out = {}
    for r in sampling.capped_per_group(docs, "g", "w", 10).collect():
        out.setdefault(r["grp"], []).append(r["weight"])
    assert set(out) == {"x", "ukjent"} and all(10 <= sum(v) < 14 for v in out.values())


def test_small_sources(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000026C000003440802000000")
    rows = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),)], "b binary").select(files.png_size(F.col("b")).alias("s")).collect()
    assert tuple(rows[0]["s"]) == (620, 836) and rows[1]["s"] is None
    states = spark.createDataFrame([(bytearray(b"%PDF-1.4 x"),), (bytearray(b"%PDF-1.4 /Encrypt 1"),), (bytearray(b"<html>"),)], "b binary").select(files.pdf_state(F.col("b")).alias("s")).collect()
    assert [r["s"] for r in states] == ["pdf", "protected", "other"]
    names = spark.createDataFrame([("m/012.pdf",), ("m/0123.pdf",), ("m/7.PDF",)], "fil string")
    chosen = lambda **k: sorted(r["fil"] for r in files.selected_files(names, **k).collect())
    assert chosen(choice=["012.pdf"], exact=True) == ["m/012.pdf"] and len(chosen(choice=["012"])) == 2 and len(chosen(count=1)) == 1 and len(chosen()) == 3
    line = "struct<text:string,score:double,poly:array<array<double>>,words:array<struct<text:string,score:double,box:array<double>>>>"
    ocr = spark.createDataFrame([(1, 1, [("a b", 0.9, [[0.0, 0.0], [9.0, 1.0], [9.0, 6.0]], [("a", None, [0.0, 0.0, 3.0, 5.0]), ("b", 0.5, [5.0, 0.0, 9.0, 5.0])]), ("c", 0.8, [[0.0, 10.0], [4.0, 12.0]], [])])], f"doc bigint, page int, lines array<{line}>")
    got = [(r["ord"], r["text"], r["x0"], r["y1"], r["rec_score"]) for r in files.word_tokens(ocr).orderBy("ord").collect()]
    assert got == [(0, "a", 0.0, 5.0, 0.9), (1, "b", 5.0, 5.0, 0.5), (2, "c", 0.0, 12.0, 0.8)]
    (tmp_path / "b.csv").write_text("fil,side,x0,y0,x1,y1\nm/0012.pdf,1,1,2,3,4\nx,1,1,2,3,4\n13.pdf,,1,2,3,4\n")
    assert [tuple(r) for r in files.box_list(spark, str(tmp_path / "b.csv")).collect()] == [(12, 1, 1.0, 2.0, 3.0, 4.0)]


def test_detector_alone_and_paddle_at_the_gate(spark):
    from kvern.operators import rules

    rows = [(1, "yolo", 0.9, 60.0, 12.0), (2, "yolo", 0.4, 13.0 * 10, 13.0), (3, "yolo", 0.6, 21.0, 20.0), (4, "yolo", 0.4, 21.0, 20.0), (5, "paddle", 0.9, 21.0, 20.0), (6, "yolo", None, 60.0, 12.0)]
    full = [(i, k, c, w, h, max(w / h, h / w), min(w, h), max(w, h), w * h, w * h * 17.36) for i, k, c, w, h in rows]
    p = spark.createDataFrame(full, "pred_id bigint, kilde string, conf double, w double, h double, elongation double, short_side double, long_side double, area double, areal_px double").withColumns({c: F.lit(None).cast("double") for c in rules.TEXT_FEATURES})
    assert sorted(r["pred_id"] for r in review.detector_only(p.where("kilde = 'yolo'")).collect()) == [1, 3]
    gone = {r["pred_id"]: r["g"] for r in p.select("pred_id", review.shape_discards().alias("g")).collect()}
    assert gone[5] and not gone[3]
