"""Layout folds, sampling, streaming, files, and queries against SQL on the smallest tables."""

import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from kvern.operators import labels as lab
from kvern.operators import layout, matching, measure, sampling, stats, views
from kvern.sources import files
from kvern.streaming import queue
from tests.test_functions import made_number

SMALL = "/root/testdata/sf0.001"


def token(text, x, y, ord_=0, width=28, height=50, rec=0.99):
    return {"text": text, "x0": float(x), "y0": float(y), "x1": float(x + width * len(text)), "y1": float(y + height), "rec_score": rec, "ord": ord_}


TOKENS = "doc bigint, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, rec_score double"
BOXES = "doc bigint, page int, ord int, x0 double, y0 double, x1 double, y1 double, conf double"


def frame(spark, *pages):
    """Tokens of pages 1, 2, ... of document 1."""
    return spark.createDataFrame([(1, i, t["ord"], t["text"], t["x0"], t["y0"], t["x1"], t["y1"], t["rec_score"]) for i, page in enumerate(pages, 1) for t in page], TOKENS)


def on_pages(df, *columns):
    out = {}
    for r in df.orderBy("page", "x0").collect():
        out.setdefault(r["page"], []).append(r if not columns else tuple(r[c] for c in columns))
    return out


def test_redaction_boxes(spark):
    n = made_number(random.Random(5))
    wrong = n[:-1] + str((int(n[-1]) + 1) % 10)
    spelled = n.replace("0", "O", 1) if "0" in n else n
    pages = [
        [token(n, 100, 100)], [token(n[:6], 100, 100), token(n[6:], 300, 100, 1)], [token(n[:6], 100, 100), token(n[6:], 300, 300, 1)], [token(wrong, 100, 100)], [token("01019012345", 100, 100)],
        [token(spelled[:1] + "." + spelled[1:], 100, 100)], [token(n[:6], 100, 100), token(n[6:8] + "." + n[8:], 300, 100, 1, rec=0.5)],
    ]
    got = on_pages(layout.redaction_boxes(layout.lines(frame(spark, *pages))))
    assert set(got) == {1, 2, 6, 7} and all(r["mod11"] for rows in got.values() for r in rows)
    (box,) = got[1]
    assert 100 + 28 * 5.5 <= box["x0"] <= 100 + 28 * 6 and box["x1"] >= 100 + 28 * 11 and box["maks_luke"] == 0 and box["rec"] == 0.99
    (box,) = got[2]
    assert 100 + 28 * 6 < box["x0"] < 300
    assert got[6][0]["har_desimal_luke"] == 1 and got[7][0]["har_desimal_luke"] == 1 and got[7][0]["rec"] == 0.5 and got[2][0]["har_desimal_luke"] == 0


def test_a_misread_digit_before_a_mark_counts_as_a_digit(spark):
    """O1.O1...: the mark stands after the second digit, where a date has it."""
    rng = random.Random(1)
    n = next(x for x in (made_number(rng) for _ in range(2000)) if x[0] == "0" and x[2] == "0")
    got = on_pages(layout.redaction_boxes(layout.lines(frame(spark, [token(f"O{n[1]}.O{n[3:]}", 100, 100)]))), "har_desimal_luke")
    assert got == {1: [(0.0,)]}


def test_lines_grow_and_ties_keep_order(spark):
    rows = layout.lines(frame(spark, [token("b", 50, 0, 1), token("a", 50, 0, 0), token("c", 90, 20, 2), token("d", 10, 90, 3)])).orderBy("line_no").collect()
    assert [r["text"] for r in rows] == ["a b c", "d"] and (rows[0]["top"], rows[0]["bottom"]) == (0.0, 70.0)
    n = made_number(random.Random(5))
    (r,) = layout.marked_lines(frame(spark, [token(" ", 0, 0), token(n, 10, 200, 1)])).collect()
    assert r["text"] == n and [tuple(m) for m in r["marks"]] == [(n, True)]


def test_merging(spark):
    n = made_number(random.Random(6))
    tokens = frame(spark, [token(n, 100, 100), token("ord", 100, 400, 1)])
    over, later = (250.0, 100.0, 410.0, 150.0, 0.4321), (250.0, 100.0, 420.0, 150.0, 0.2)
    word, empty, tall = (100.0, 400.0, 184.0, 450.0, 0.9), (900.0, 900.0, 1000.0, 950.0, 0.3), (1500.0, 900.0, 1520.0, 950.0, 0.3)
    boxes = lambda *bs: spark.createDataFrame([(1, 1, i, *b) for i, b in enumerate(bs)], BOXES)
    assert on_pages(layout.merge_boxes(tokens, boxes(over)), "kilde", "conf") == {1: [("begge", 0.432)]}
    assert on_pages(layout.merge_boxes(tokens, boxes(over, later)), "kilde", "conf") == {1: [("begge", 0.2)]}
    # a duplicate of an earlier box, one below the floor, one whose text is no number, and one without text beside the first
    kinds = on_pages(layout.merge_boxes(tokens, boxes(over, word, empty, empty, (1200.0, 900.0, 1300.0, 950.0, 0.01), tall, (960.0, 900.0, 1060.0, 950.0, 0.3))), "kilde")
    assert kinds == {1: [("begge",), ("yolo",), ("yolo",), ("yolo_vertikal",)]}


def test_context_and_guard_line(spark):
    tokens = frame(spark, [token("over", 0, 0, 0), token("Kari", 0, 100, 1), token("12345", 300, 105, 2), token(" ", 600, 100, 3), token("under", 0, 200, 4), token("sist", 0, 300, 5)])
    box = spark.createDataFrame([(1, 1, 0, 290.0, 100.0, 450.0, 150.0, 0.5), (1, 1, 1, 0.0, 900.0, 50.0, 950.0, 0.5), (2, 1, 0, 0.0, 0.0, 5.0, 5.0, 0.5)], BOXES)
    got = {(r["doc"], r["ord"]): (r["boks_tekst"], r["linje_tekst"], r["blokk_tekst"]) for r in layout.context(tokens, box, 1).collect()}
    assert got[1, 0] == ("12345", "Kari 12345", "over\nKari 12345\nunder") and got[1, 1] == ("", "", "under\nsist") and got[2, 0] == ("", "", "")
    lines = {(r["doc"], r["ord"]): r["linje"] for r in layout.guard_lines(tokens, box).collect()}
    assert lines == {(1, 0): "Kari 12345  ", (1, 1): "", (2, 0): ""} or lines[1, 0].startswith("Kari 12345")


def test_layout_frames_and_empty_pages(spark):
    n = made_number(random.Random(7))
    texts = spark.createDataFrame([(1, f"fnr {n}\nto linjer"), (2, ""), (3, "12"), (4, None)], "id bigint, t string")
    tokens = layout.text_tokens(texts.where("t is not null"), "id", "t")
    lines = sorted((r["doc"], r["text"]) for r in layout.lines_from_tokens(tokens).collect())
    assert lines == [(1, f"fnr {n}"), (1, "to linjer"), (3, "12")]
    det = spark.createDataFrame([(3, 1, 0, 0.0, 0.0, 60.0, 50.0, 0.5), (9, 1, 0, 0.0, 0.0, 60.0, 50.0, 0.5)], "doc bigint, page int, ord int, x0 double, y0 double, x1 double, y1 double, conf double")
    got = sorted((r["doc"], r["kilde"]) for r in layout.merge_boxes(tokens, det).collect())
    assert got == [(1, "paddle"), (3, "yolo"), (9, "yolo")]
    f = {r["doc"]: (r["har_tokens"], r["n_siffer"], r["n_bokstaver"]) for r in layout.box_text_features(tokens, det).collect()}
    assert f == {3: (1, 2, 0), 9: (0, 0, 0)}


def test_strips_do_not_lose_or_repeat_pairs(spark):
    rng = random.Random(8)
    box = lambda: (x := rng.uniform(-50, 500), y := rng.uniform(-100, 800), x + rng.uniform(1, 300), y + rng.uniform(1, 700))
    ps, ts = [(i, *box()) for i in range(60)], [(f"t{i}", *box()) for i in range(60)]
    preds = spark.createDataFrame([(i, 1, 1, x0 / 600, y0 / 850, x1 / 600, y1 / 850, (x1 - x0) * (y1 - y0) / 510000) for i, x0, y0, x1, y1 in ps], "pred_id bigint, doc_no bigint, side int, nx0 double, ny0 double, nx1 double, ny1 double, norm_area double")
    truth = spark.createDataFrame([(i, 1, 1, x0 / 600, y0 / 850, x1 / 600, y1 / 850, True, (x1 - x0) * (y1 - y0) / 510000) for i, x0, y0, x1, y1 in ts], "label_id string, doc_no bigint, side int, nx0 double, ny0 double, nx1 double, ny1 double, horizontal boolean, norm_area double")
    got = [(r[0], r[1]) for r in matching.overlapping_pairs(preds, truth).select("pred_id", "label_id").collect()]
    want = {(i, j) for i, *p in ps for j, *t in ts if min(p[2], t[2]) > max(p[0], t[0]) and min(p[3], t[3]) > max(p[1], t[1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_hash_percent_is_exact(spark):
    import hashlib

    names = [f"n{i}" for i in range(200)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", sampling.hash_percent(F.col("n")).alias("p")).collect()
    assert all(r["p"] == int(hashlib.md5(r["n"].encode()).hexdigest(), 16) % 100 for r in got)


def test_splits_do_not_depend_on_partitions(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_no"), (F.col("id") % 7 + 1).alias("w"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("s"))
    one, many = docs.coalesce(1), docs.repartition(7)
    for f in (lambda d: sampling.quota_split(d, "w", 0.8, 0.1), lambda d: sampling.stratified_holdout(d, "s", 0.2), lambda d: measure.holdout_documents(d, 0.3), lambda d: sampling.capped_per_group(d, "s", "w", 20)):
        assert sorted(f(one).collect()) == sorted(f(many).collect())
    assert measure.holdout_documents(docs, 0.3).count() == 150 and measure.holdout_documents(docs.limit(1), 0.1).count() == 1
    assert measure.holdout_documents(docs.limit(0), 0.3).count() == 0
    parts = {r["split"]: r["w"] for r in sampling.quota_split(docs, "w", 0.8, 0.1).groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = sum(parts.values())
    assert abs(parts["train"] / total - 0.8) < 0.01


def test_breaker_batch_and_stream(spark, tmp_path):
    log = [("a", float(i), i, ok) for i, ok in enumerate([False] * 5 + [True] * 3 + [False] * 40)] + [("b", 0.0, 0, True), ("b", 5.0, 1, False)]
    df = spark.createDataFrame(log, "endpoint string, seconds double, `order` int, ok boolean")
    batch = sorted(map(tuple, queue.breaker_replay(df).collect()))
    state, opened = queue.breaker_steps((0, 0.0), [(s, ok) for e, s, _, ok in log if e == "a"])
    assert batch[0] == ("a", 48, sum(not o and not ok for o, (_, _, _, ok) in zip(opened, log)), sum(opened)) and batch[1] == ("b", 2, 1, 0)
    assert opened[5] and not opened[4] and state[0] < 5
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = queue.breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("breaker").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("breaker").collect())) == batch


def test_replace_on_write_and_resume(spark, tmp_path):
    box = "doc_no bigint, boxes array<struct<page:int,x:double>>"
    sink = queue.replace_documents(str(tmp_path / "sink"))
    sink(spark.createDataFrame([(1, [(1, 2.0)]), (2, [(1, 3.0)])], box), 0)
    sink(spark.createDataFrame([(2, [])], box), 1)
    sink(spark.createDataFrame([(2, [])], box), 1)
    held = {r["doc_no"]: json.loads(r["value"])["boxes"] for r in queue.stored_boxes(spark, str(tmp_path / "sink")).collect()}
    assert held == {1: [{"page": 1, "x": 2.0}], 2: []}
    items = spark.createDataFrame([(1,), (3,)], "doc_no bigint")
    assert [r[0] for r in queue.resumable(items, spark.createDataFrame([(1,)], "doc_no bigint")).collect()] == [3]


def test_queue_documents_and_answers(spark):
    docs = spark.createDataFrame([((2000, 5, 1), True, ["SE_SEK"], "12"), (None, None, None, "13")], queue.QUEUE_SCHEMA)
    got = [(r["doc_no"], r["codes"], r["electronic"], r["usable"]) for r in queue.queue_items(docs).collect()]
    assert got == [(12, ["SE_SEK"], True, True), (13, [], False, False)]
    answers = spark.createDataFrame([(1, '{"pipeline_version": "1", "boxes": [{"page": 1, "x": 2.0}]}'), (2, '[{"page": 3, "x": 4.0}]'), (3, "nonsense")], "doc_no bigint, answer string")
    assert sorted((r["doc_no"], r["page"], r["x"]) for r in queue.answer_boxes(answers).collect()) == [(1, 1, 2.0), (2, 3, 4.0)]


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) as ts, id % 3 as user_id, 'a' as event_type, 1.5D as value from range(50)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = queue.tumbling(stream, late="0 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, queue.tumbling(rows).collect()))


def test_throughput(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 30, 10), (1, 100, 20), (1, 100, 20)], "worker int, at bigint, docs bigint")
    got = {r["at"]: r["per_second"] for r in queue.throughput(p).collect()}
    assert got == {0: None, 30: round(10 / 30, 6), 100: round(10 / 70, 6)}


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿navn,side,bilde_bredde,bilde_hoyde,x0,y0,x1,y1,kilde,conf\n1.pdf,1,100,200,1,2,3,4,yolo,0.5\n2.pdf,x,100,200,1,2,3,4,yolo,\n", encoding="utf-8")
    r = files.result_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [(x["navn"], x["yolo_conf"], x["har_tokens"]) for x in r] == [("1.pdf", 0.5, None)]
    (tmp_path / "ids.txt").write_text("# head\na1 # note\n\nb2\na1\n")
    assert sorted(x[0] for x in files.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a1", "b2"]
    (tmp_path / "docs.txt").write_text("# x\n0012.pdf\n34\n")
    assert sorted(x[0] for x in files.document_list(spark, str(tmp_path / "docs.txt")).collect()) == [12, 34]
    (tmp_path / "added.csv").write_text("# note\nfil_revisjon_id,sidetall,x,y,width,height,type,kommentar\n7.0,2,10,20,30,5,FNR,k\n")
    a = files.added_csv(spark, str(tmp_path / "added.csv")).first()
    assert a["doc_no"] == 7 and a["side"] == 2 and a["label_id"].startswith("mangler-") and a["x1"] == 40.0
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "12.json").write_text(json.dumps({"version": 2, "ocr_model": "v6", "dpi": 300, "pages": [{"page": 1, "rotation": 0, "tokens": [{"text": "a", "x0": 1, "y0": 1, "x1": 2, "y1": 2, "rec_score": 0.9}]}]}))
    (tmp_path / "ocr" / "13.json").write_text(json.dumps({"version": 1, "ocr_model": "v6", "dpi": 300, "pages": []}))
    assert [(x["doc"], x["text"]) for x in files.ocr_cache(spark, str(tmp_path / "ocr")).collect()] == [(12, "a")]
    (tmp_path / "det").mkdir()
    for doc, rot in ((12, 0), (13, 1)):
        (tmp_path / "det" / f"{doc}.json").write_text(json.dumps({"version": 1, "imgsz": 1280, "dpi": 300, "conf_floor": 0.01, "pages": [{"page": 1, "rotation": rot, "boxes": [[1, 2, 3, 4, 0.5], [1, 2, 3, 4, 0.001]]}]}))
    rotations = spark.createDataFrame([(12, 1, 0), (13, 1, 0)], "doc bigint, page int, rotation int")
    assert [(x["doc"], x["conf"]) for x in files.detector_cache(spark, str(tmp_path / "det"), rotations).collect()] == [(12, 0.5)]
    (tmp_path / "s.csv").write_text("## Overall\npred,10\n## Per type\nFNR,3\n")
    assert sorted((x["section"], x["key"], x["value"]) for x in files.sectioned_csv(spark, str(tmp_path / "s.csv")).collect()) == [("Overall", "pred", "10"), ("Per type", "FNR", "3")]
    files.write_once(spark.range(3), str(tmp_path / "once"))
    files.write_once(spark.range(9), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3


def test_added_rows_meet_the_file(spark):
    labels = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 10.0, 5.0, "FNR", "ACCEPTED"), ("b", 1, 1, 50.0, 0.0, 60.0, 5.0, "FNR", "REJECTED"), ("c", 1, 2, 0.0, 0.0, 10.0, 5.0, "FNR", "")], "label_id string, doc_no bigint, side int, x0 double, y0 double, x1 double, y1 double, type string, status string")
    added = lab.added_rows(spark.createDataFrame([(1, 1, 1.0, 1.0, 9.0, 4.0), (1, 1, 50.0, 0.0, 60.0, 5.0)], "doc_no bigint, side int, x0 double, y0 double, x1 double, y1 double"))
    out = sorted((r["origin"], r["outcome"]) for r in lab.policy(labels, spark.createDataFrame([("c",)], "label_id string"), added).collect())
    assert out == [("added", "kept"), ("added", "present"), ("file", "excluded REJECTED"), ("file", "kept"), ("file", "retracted")]


def test_index_percentiles(spark):
    rng = random.Random(10)
    v = [float(rng.randrange(40)) for _ in range(137)]
    r = stats.index_percentiles(spark.createDataFrame([("k", x) for x in v] + [("k", None)], "g string, v double"), "g", "v").first()
    s = sorted(v)
    assert all(r[f"a{p}"] == s[min(int(137 * p / 100), 136)] and r[f"b{p}"] == s[int(p * 136 / 100)] for p in (5, 25, 50, 75, 95)) and r["upper_median"] == s[137 // 2]


def test_pareto(spark):
    m = spark.createDataFrame([("a", 0, 5), ("b", 0, 7), ("c", 1, 7), ("d", 2, 9), ("e", 3, 8)], "config_id string, lost bigint, ov_rm bigint")
    assert sorted(r[0] for r in measure.pareto(m).collect()) == ["b", "d"]


def normal(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["match_summary", "measure_configs", "label_policy_tally", "code_density", "fnr_scan", "verdict_confusion", "shape_percentiles", "quota_split", "crop_plan", "answer_parse", "secret_scan", "redaction_boxes", "rule_reasons_histogram", "verdict_bound", "breaker_replay", "placement_census", "holdout_pools", "split_with_negatives", "files_results", "queue_replace", "numbered_boxes"])
def test_query_equals_sql(spark, name):
    import duckdb

    from kvern.plans import catalogue

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = catalogue.QUERIES[name](spark, SMALL).toPandas(), con.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and normal(got) == normal(want)


def test_empty_tables(spark):
    small = SMALL if os.path.isdir(SMALL) else None
    if not small:
        pytest.skip("needs the driver's tables")
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet").limit(0)
    preds, labels = views.predictions(t("resultat")), views.label_rows(t("labels"))
    truth = matching.truth_boxes(labels, views.page_sizes(t("resultat")))
    pairs = matching.overlapping_pairs(preds, truth)
    edges = matching.covers(pairs)
    c = matching.classify(preds, edges)
    assert matching.class_summary(c).count() == 0 and stats.page_share(labels).count() <= 1
    assert measure.measure(c, edges, truth, [("x", None, {"max_height": 40})]).first()["n_rm"] == 0
    assert not math.isnan(measure.measure(c, edges, truth, [("x", None, {})]).first()["recall_after"])
