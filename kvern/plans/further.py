"""Further queries: answers and their cache, pages beside their labels, data sets, smaller reports, and files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions import geometry as g
from kvern.functions import numbers, scalar, text
from kvern.functions.keys import doc_number
from kvern.operators import answers, dataset, layout, matching, measure, offpage, review, rules, stats
from kvern.plans.catalogue import Base, _page_tokens, production_configs, query, side_files
from kvern.session import materialize, scratch_path
from kvern.sources import files
from kvern.streaming import queue

# ----- rows and boxes


@query
def label_row_texts(b):
    return review.label_row_texts(b.preds)


@query
def label_row_texts_bottom(b):
    return review.label_row_texts(b.preds, "bottom").select("pred_id", "y", "height")


@query
def labels_from_below(b):
    """label_id and its box relative to its page, with the origin of y at the bottom."""
    rows = b.labels.join(b.pages, ["doc_no", "side"])
    box = offpage.flipped(g.Box.of(), F.col("ph"), "bottom").scaled(F.col("pw"), F.col("ph"))
    return rows.select("label_id", *[F.round(c, 6).alias(n) for n, c in zip(g.Box._fields, box)])


@query
def prefilters(b):
    """pred_id of boxes that are at most 80 points wide and aren't doubtful detector boxes."""
    return review.not_doubtful(review.not_wide(b.preds, 80.0), 0.4).select("pred_id")


@query
def before_after(b):
    """The evaluation before and after dropping wide boxes."""
    inside, truth, pairs = b.matched()
    kept = materialize(review.not_wide(inside, 40.0))
    after = matching.best_matches(kept, truth, pairs.join(kept.select("pred_id"), "pred_id", "left_semi"))
    return review.before_after(stats.eval_overall(matching.best_matches(inside, truth, pairs), inside), stats.eval_overall(after, kept))


@query
def preflight(b):
    return review.preflight(b.preds)


@query
def labelled_pages(b):
    return review.labelled_pages(b.labels)


@query
def drawn_pages(b):
    inside, truth, _ = b.matched()
    return review.drawn_pages(inside, truth)


@query
def truth_lists(b):
    c, e, _ = b.classified()
    return review.truth_lists(c, e)


@query
def page_severity(b):
    c, e, t = b.stored()
    gone = F.lit(False)
    for kilde, config in rules.ANY_CONFIDENCE.items():
        gone = gone | ((F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    lost = review.lost_truth(c, e, gone).select("label_id").distinct().join(t.select("label_id", "doc_no", "side"), "label_id")
    return review.page_severity(stats.removal_kinds(c, e, gone), lost, 25)


@query
def uncovered_order(b):
    inside, truth, pairs = b.matched()
    return review.uncovered_order(matching.best_matches(inside, truth, pairs), truth)


@query
def discarded_lookup(b):
    """Labels of unusual shape, looked up in the truth by rounded corner, with what production's area and noise limits lose."""
    c, e, t = b.stored()
    gone = F.lit(False)
    for kilde, config in rules.ANY_CONFIDENCE.items():
        gone = gone | ((F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    odd = b.labels.where("(x1 - x0) < 2 * (y1 - y0)")
    return review.discarded_lookup(odd, t, review.lost_truth(c, e, gone))


@query
def sent_evaluation(b):
    """The evaluation over the documents of the test split alone."""
    sent = b.table("splittliste").where("lower(trim(splitt)) = 'test'").select(doc_number(F.col("fil")).alias("doc_no")).where("doc_no is not null").distinct()
    matches, inside = b.best()
    return review.sent_evaluation(matches, inside, sent)


@query
def scope_sizes(b):
    """scope, docs, boxes: labelled documents that ran, and all that ran."""
    ran, labelled = b.preds.select("doc_no", "pred_id"), b.labels.where("status <> 'REJECTED'").select("doc_no").distinct()
    size = lambda df, name: df.agg(F.count_distinct("doc_no").alias("docs"), F.count(F.lit(1)).alias("boxes")).select(F.lit(name).alias("scope"), "docs", "boxes")
    return size(ran.join(labelled, "doc_no", "left_semi"), "labelled").union(size(ran, "all"))


@query
def zero_area_tally(b):
    """reason, n: why label rows are no truth."""
    from kvern.operators.views import latest_labels
    from kvern.functions.keys import number, whole_number

    rows = latest_labels(b.table("labels")).select(doc_number(F.col("fil_revisjon_id")).alias("d"), whole_number(F.col("sidetall")).alias("s"), *[number(F.col(c)).alias(c) for c in ("x", "y", "width", "height")], F.upper(F.trim("ml_status")).alias("st"))
    reason = F.when(F.col("d").isNull() | F.col("s").isNull(), "no page").when(F.col("x").isNull() | F.col("y").isNull() | F.col("width").isNull() | F.col("height").isNull(), "no box").when((F.col("width") == 0) | (F.col("height") == 0), "no area").when(F.col("st") == "REJECTED", "rejected").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def live_summary(b):
    return review.live_summary(b.preds)


@query
def profile_shares(b):
    """The event types that take most of all workers' events."""
    e = b.table("events").groupBy((F.col("user_id") % 4).alias("worker"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return review.profile_shares(e, 3)


@query
def constrained_sweep(b):
    """The one-parameter rows that lose at most two and gain more than the cost, by net."""
    from kvern.plans.catalogue import axis_configs

    m = measure.within(measure.measure(*b.stored(), axis_configs()), max_lost=2, min_ov_lost=5.0)
    return measure.sort_by(m, "net").select("config_id", "lost", "ov_rm", "net")


@query
def seed_shortlist(b):
    """config_id, seeds: production configs that cost nothing net on the holdouts of how many of three seeds."""
    c, e, t = b.stored()
    out = None
    for seed in (1, 2, 3):
        docs = materialize(measure.holdout_documents(c.select("doc_no").distinct(), 0.3, seed))
        good = measure.measure(*measure.restricted(c, e, t, docs), production_configs()).where("net > 0").select("config_id")
        out = good if out is None else out.union(good)
    return out.groupBy("config_id").agg(F.count(F.lit(1)).alias("seeds"))


@query
def rejected_shapes(b):
    """reason, status, n, share of rejection reasons of label boxes under the shape limits, per status."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shape = {"w": w, "h": h, "elongation": F.greatest(w / h, h / w), "short_side": F.least(w, h), "long_side": F.greatest(w, h), "area": w * h, "areal_px": w * h * g.PX_PER_PT * g.PX_PER_PT}
    none = F.lit(None).cast("double")
    why = rules.reasons(rules.literal({"min_elongation": 1.44, "max_elongation": 9.0, "min_short_side": 6.0, "min_area_px": 965}), lambda n: shape.get(n, none))
    per = b.labels.select("status", F.explode(why).alias("r")).groupBy(text.first_number_masked(F.col("r")).alias("reason"), "status").agg(F.count(F.lit(1)).alias("n"))
    return per.join(b.labels.groupBy("status").agg(F.count(F.lit(1)).alias("of")), "status").select("reason", "status", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"))


# ----- pages

def page_boxes(b: Base) -> DataFrame:
    """Page boxes derived from the page sizes: lying pages are turned by 90 degrees; documents divisible by 7 have a crop box ten points inside."""
    lying, crop = F.col("pw") > F.col("ph"), F.col("doc_no") % 7 == 0
    w, h = F.when(lying, F.col("ph")).otherwise(F.col("pw")), F.when(lying, F.col("pw")).otherwise(F.col("ph"))
    cut = F.when(crop, 10.0).otherwise(0.0)
    return b.pages.select("doc_no", "side", F.when(lying, 90).otherwise(0).alias("rotate"), w.alias("mw"), h.alias("mh"), cut.alias("cx"), cut.alias("cy"), (w - 2 * cut).alias("cw"), (h - 2 * cut).alias("ch"), (F.col("pw") - 2 * cut).alias("vw"), (F.col("ph") - 2 * cut).alias("vh"))


@query
def page_census(b):
    return offpage.page_census(page_boxes(b))


@query
def placement_census(b):
    return offpage.placement_census(b.labels, page_boxes(b))


@query
def placement_census_bottom(b):
    return offpage.placement_census(b.labels, page_boxes(b), "bottom")


@query
def burned_labels(b):
    return b.labels.where(offpage.burned()).groupBy(offpage.who().alias("who"), "status").agg(F.count(F.lit(1)).alias("n"))


def _candidates(b: Base) -> DataFrame:
    return materialize(offpage.covered_candidates(layout.candidate_boxes(layout.lines(_page_tokens(b))), b.labels, b.pages))


@query
def covered_candidates(b):
    return _candidates(b)


@query
def off_page_verdicts(b):
    return offpage.off_page_verdicts(b.labels, _candidates(b), b.pages)


# ----- answers

def _items(b: Base) -> DataFrame:
    return b.manifest.join(b.table("manifest").where("nr is not null").groupBy("nr").agg(F.min("utsnitt").alias("utsnitt")), "nr").withColumn("key", answers.item_key(F.col("utsnitt"), F.col("ocr_tekst")))


def _cache(b: Base) -> DataFrame:
    """The stored answers: readable raw answers of verdicts, under the key of their manifest row."""
    raw = b.table("verdicts").where("nr is not null and raatekst is not null").select("nr", F.col("raatekst").alias("raw")).distinct().join(_items(b).select("nr", "key"), "nr")
    return answers.to_store(raw.select("key", "raw"))


@query
def answer_keys(b):
    """nr and the content key of what the judge is shown; version is the fingerprint of the settings."""
    version = answers.fingerprint(prompt="p", templates="", model="m", mode="crop", temperature=0.0, max_tokens=150, thinking=None)
    return _items(b).select("nr", "key", F.lit(version).alias("version"))


@query
def answer_lookup(b):
    return answers.looked_up(_items(b), _cache(b)).select("nr", "svar", "note")


@query
def unreadable_answers(b):
    """verdict_id, note of raw answers that must not be cached."""
    read = text.with_answer(b.table("verdicts").select("verdict_id", "raatekst").distinct(), "raatekst", "a").where("a.feil <> ''")
    short = F.create_map(*[F.lit(x) for kv in answers.SHORT.items() for x in kv])
    return read.select("verdict_id", F.coalesce(short[F.col("a.feil")], F.lit("unparsed")).alias("note"))


def _judged_notes(b: Base) -> DataFrame:
    """Judged rows with a note: hit where the first attempt was free of errors, else call failed; dropped is nei."""
    return b.judged.select("nr", "doc_no", "kilde", (F.col("svar") == "nei").alias("dropped"), F.when(F.col("feil") == "", "hit").otherwise("call failed").alias("note"))


@query
def verdict_counters(b):
    return answers.counters(_judged_notes(b))


@query
def failed_documents(b):
    return answers.failed_documents(_judged_notes(b))


@query
def undecided_rows(b):
    return answers.undecided(b.manifest).select("nr")


@query
def rule_baselines(b):
    return answers.baselines(b.manifest)


@query
def short_errors(b):
    rows = b.table("verdicts").where("feil is not null").select("verdict_id", "feil").distinct()
    return rows.select("verdict_id", answers.short_error(F.col("feil")).alias("short"), answers.is_memory_error(F.col("feil")).alias("memory"))


@query
def review_table(b):
    return answers.review_rows(b.judged)


@query
def verdict_marks(b):
    return b.judged.groupBy(review.verdict_mark(F.col("gruppe"), F.col("svar")).alias("mark"), "klasse").agg(F.count(F.lit(1)).alias("n"))


@query
def synced_classes(b):
    """nr, klasse of stored verdict rows after a newer manifest, in which every fifth row has become TREFF."""
    stored = b.judged.select("nr", "klasse")
    newer = b.manifest.where("nr % 3 <> 0").withColumn("klasse", F.when(F.col("nr") % 5 == 0, "TREFF").otherwise(F.col("klasse")))
    return review.synced_classes(stored, newer)


# ----- data sets

@query
def holdout_pools(b):
    return dataset.holdout_pools(b.labels, b.meta, 0.2, 40, 60)


def _paged(b: Base) -> DataFrame:
    return b.pages.groupBy("doc_no").agg(F.count(F.lit(1)).alias("pages"))


@query
def split_with_negatives(b):
    """Documents with labels by quota of pages, and documents without labels up to a tenth of them."""
    docs = materialize(_paged(b))
    positives = materialize(dataset.strategy_split(docs.join(b.labels.select("doc_no").distinct(), "doc_no", "left_semi"), F.lit(True), "pages").withColumnRenamed("weight", "pages"))
    return dataset.with_negatives(positives, docs.join(b.labels.select("doc_no"), "doc_no", "left_anti"), "pages")


@query
def split_by_code(b):
    """The split of documents of one type in a range of years."""
    docs = _paged(b).join(b.meta, "doc_no")
    return dataset.strategy_split(docs, F.exists("codes", lambda c: c.startswith("HJ_")) & F.col("year").between(1950, 2020), "pages")


@query
def pages_without_labels(b):
    return dataset.pages_without_labels(b.pages, b.labels)


@query
def first_pages(b):
    return review.first_pages(_paged(b), "pages", 100)


@query
def hard_union(b):
    return review.hard_union(b.table("splittliste").where("lower(trim(splitt)) = 'val'").select(doc_number(F.col("fil")).alias("doc_no")).where("doc_no is not null"), stats.hard_documents(b.judged))


@query
def chosen_files(b):
    """fil of the split lists' names that hold one of two parts."""
    return files.selected_files(b.table("splittliste").where("fil is not null").select(F.trim("fil").alias("fil")), ["102", "33.pdf"])


# ----- incremental

@query
def batch_sizes(b):
    e = b.table("events").select((F.col("user_id") % 8).alias("worker"), F.col("event_id").alias("order"), (F.col("event_type") != "error").alias("ok"))
    return queue.batch_sizes(e)


@query
def progress(b):
    """hour, done, share: events done up to each hour and their share of all."""
    e = b.table("events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count(F.lit(1)).alias("k"))
    # one row an hour: the window runs over hours, not over events
    done = F.sum("k").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("done", done).join(e.agg(F.sum("k").alias("all_k"))).select(F.unix_micros("h").alias("hour"), "done", F.round(F.col("done") / F.col("all_k"), 6).alias("share"))


# ----- files written and read back

@query
def files_results(b):
    """The result table through CSV."""
    path = scratch_path(b.spark)
    files.write_result_csv(b.table("resultat").dropDuplicates(["pred_id"]).where("pred_id is not null").drop("pred_id", "kjort"), path)
    back = files.result_csv(b.spark, path)
    return back.groupBy("navn", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x0"), 3).alias("x0"), F.count("yolo_conf").alias("with_conf"), F.count("maks_luke").alias("with_window"))


@query
def files_result_pages(b):
    """navn, side, n, first: the result table per page, through the sink by name and page."""
    path = scratch_path(b.spark)
    files.write_result_csv(b.table("resultat").dropDuplicates(["pred_id"]).where("pred_id is not null and navn is not null and side is not null").drop("pred_id", "kjort"), path)
    rows = files.page_boxes_of_results(files.result_csv(b.spark, path))
    return rows.select("navn", "side", F.size("boxes").alias("n"), F.round(F.col("boxes")[0]["y0"], 4).alias("first"))


def _lines(b: Base, df: DataFrame) -> str:
    path = scratch_path(b.spark)
    df.write.text(path)
    return path


@query
def files_id_lists(b):
    """list, n, highest: retraction ids and processed documents through text lists with comments."""
    gone, _ = side_files(b)
    ids = files.id_list(b.spark, _lines(b, gone.select(F.concat("label_id", F.lit("  # noted")).alias("value")).union(b.spark.createDataFrame([("# all",)], "value string"))))
    docs = files.document_list(b.spark, _lines(b, b.preds.select(F.concat(F.lit("mappe/000"), F.col("doc_no"), F.lit(".pdf")).alias("value")).union(b.spark.createDataFrame([("# 7",)], "value string"))))
    size = lambda df, c, name: df.agg(F.count(F.lit(1)).alias("n"), F.max(c).cast("string").alias("highest")).select(F.lit(name).alias("list"), "n", "highest")
    return size(ids, "id", "retracted").union(size(docs, "doc_no", "processed"))


@query
def files_added(b):
    """The added labels through their CSV with a comment line."""
    _, added = side_files(b)
    path = scratch_path(b.spark)
    two = lambda c, n: F.format_string("%.2f", c).alias(n)
    box = g.Box.of()
    files.write_text_csv(added.select(F.col("doc_no").cast("string").alias("fil_revisjon_id"), F.col("side").cast("string").alias("sidetall"), two(box.x0, "x"), two(box.y0, "y"), two(box.width, "width"), two(box.height, "height")), path)
    return files.added_csv(b.spark, path).select("doc_no", "side", *[F.round(c, 2).alias(c) for c in g.Box._fields])


@query
def files_sent(b):
    """Predictions as label rows through their CSV, on pages that exist."""
    path = scratch_path(b.spark)
    files.write_text_csv(review.label_row_texts(b.preds).drop("pred_id"), path)
    return files.sent_csv(b.spark, path, b.pages).groupBy("doc_no", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x0"), 2).alias("x0"))


@query
def files_box_list(b):
    """nr of the manifest boxes that a list of boxes names within three pixels."""
    path = scratch_path(b.spark)
    boxes = b.manifest.where("nr % 4 = 0 and x0 is not null and doc_no is not null and side is not null")
    files.write_text_csv(boxes.select(F.concat("doc_no", F.lit(".pdf")).alias("fil"), "side", *[(F.col(c) + 1.5).alias(c) for c in g.Box._fields]), path)
    m, l = b.manifest.alias("m"), files.box_list(b.spark, path).alias("l")
    on = (F.col("m.doc_no") == F.col("l.doc_no")) & (F.col("m.side") == F.col("l.side")) & g.equal_within(g.Box.of("m."), g.Box.of("l."), 3.0)
    return m.join(l, on, "left_semi").select("nr")


@query
def files_label_files(b):
    """Label files through their folders."""
    path = scratch_path(b.spark)
    files.write_label_files(b.labels, b.pages, path)
    return b.spark.read.schema("doc_no bigint, side int, content string").json(path).select("doc_no", "side", F.size(F.split("content", "\n")).alias("n_lines"))


@query
def files_code_lists(b):
    """code, n of the document lists per code through their folders."""
    path = scratch_path(b.spark)
    files.write_code_lists(b.meta, path)
    return b.spark.read.text(path).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _written_caches(b: Base) -> tuple[str, str]:
    """OCR caches of the pages' tokens, and detector caches of resultat; documents divisible by 5 have an OCR cache of another version."""
    ocr, det = scratch_path(b.spark), scratch_path(b.spark)
    token = F.struct("ord", "text", "x0", "y0", "x1", "y1", "rec_score")
    pages = _page_tokens(b).groupBy("doc", "page").agg(F.array_sort(F.collect_list(token)).alias("t"))
    page = F.struct("page", F.lit(0).alias("rotation"), F.transform("t", lambda t: t.dropFields("ord")).alias("tokens"))
    docs = pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    docs.select(F.concat("doc", F.lit(".pdf")).alias("name"), F.when(F.col("doc") % 5 == 0, 1).otherwise(2).alias("version"), F.lit("v6").alias("ocr_model"), F.lit(300).alias("dpi"), "pages").write.json(ocr)
    boxes = b.preds.where("conf is not null").select(F.col("doc_no").alias("doc"), F.col("side").alias("page"), F.array("x0", "y0", "x1", "y1", "conf").alias("box"))
    held = pages.select("doc", "page").join(boxes, ["doc", "page"], "left").groupBy("doc", "page").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    docs = held.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", F.lit(0).alias("rotation"), "boxes"))).alias("pages"))
    docs.select(F.concat("doc", F.lit(".pdf")).alias("name"), F.lit(1).alias("version"), F.when(F.col("doc") % 7 == 0, 640).otherwise(1280).alias("imgsz"), F.lit(300).alias("dpi"), F.lit(0.01).alias("conf_floor"), "pages").write.json(det)
    return ocr, det


@query
def files_caches(b):
    """doc, n_tokens, n_boxes of the documents whose caches are valid; a detector cache needs the rotations of the OCR cache."""
    ocr, det = _written_caches(b)
    tokens = files.ocr_cache(b.spark, ocr, per_line=True).groupBy("doc").agg(F.count(F.lit(1)).alias("n_tokens"))
    rotations = files.ocr_pages(b.spark, ocr, per_line=True)
    boxes = files.detector_cache(b.spark, det, rotations, per_line=True).groupBy("doc").agg(F.count(F.lit(1)).alias("n_boxes"))
    return tokens.join(boxes, "doc", "full").select("doc", "n_tokens", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


@query
def missing_caches(b):
    """doc of the documents with predictions that lack a valid cache."""
    ocr, det = _written_caches(b)
    rotations = files.ocr_pages(b.spark, ocr, per_line=True)
    return files.missing_caches(b.preds.select(F.col("doc_no").alias("doc")), rotations, files.detector_cache(b.spark, det, rotations, per_line=True))


@query
def files_run(b):
    """section, key, value of a run's summary, through its folder."""
    path = scratch_path(b.spark)
    matches, inside = b.best()
    overall = stats.eval_overall(matches, inside).first().asDict()
    files.write_run(stats.eval_miss_pages(matches), {"Overall": {k: overall[k] for k in ("truth", "hit", "pred", "surplus")}}, path, "Folder: x\nMappe: y")
    summary = files.sectioned_csv(b.spark, f"{path}/sammendrag").select("section", "key", "value")
    details = files.text_csv(b.spark, f"{path}/detaljer").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("Details").alias("section"), F.lit("pages").alias("key"), "value")
    log = files.log_header(b.spark, f"{path}/logg", {"folder": "Folder:|Mappe:"}).select(F.lit("Log").alias("section"), F.col("name").alias("key"), "value")
    return summary.union(details).union(log)


@query
def files_judgements(b):
    """nr, riktig, klasse, svar of the judgements without their content, through CSV; the numbered rows of the review table are counted in `lines`."""
    path = scratch_path(b.spark)
    files.write_judgements(answers.review_rows(b.judged), path, ["nr", "riktig", "klasse", "svar"])
    lines = b.spark.read.text(f"{path}/gjennomgang").where("value like '| %'").agg(F.count(F.lit(1)).alias("lines"))
    return files.text_csv(b.spark, f"{path}/uten_innhold").select(F.col("nr").cast("bigint").alias("nr"), "riktig", "klasse", "svar").join(lines)


@query
def files_manifest(b):
    """klasse, n, factor: a drawn manifest and its sampling factors, through CSV and JSON."""
    path = scratch_path(b.spark)
    rows = b.manifest.where("klasse = 'BOM' or nr % 2 = 0").select("nr", "klasse", "kilde")
    n = b.manifest.agg(F.count_if(F.col("klasse") != "BOM").alias("a"), F.count_if((F.col("klasse") != "BOM") & (F.col("nr") % 2 == 0)).alias("k")).first()
    files.write_manifest(rows, {"hit_factor": n["a"] / n["k"] if n["k"] else 0.0}, path)
    factor = b.spark.read.text(f"{path}/utvalg").select(F.get_json_object("value", "$.hit_factor").cast("double").alias("f"))
    per = files.text_csv(b.spark, f"{path}/manifest").groupBy("klasse").agg(F.count(F.lit(1)).alias("n")).join(factor)
    return per.select("klasse", "n", F.round(F.when(F.col("klasse") == "BOM", 1.0).otherwise(F.col("f")), 6).alias("factor"))


@query
def files_answers(b):
    """key, n: readable answers through the cache's JSON lines."""
    path = scratch_path(b.spark)
    files.write_answers(_cache(b), path)
    return answers.usable(files.answer_cache(b.spark, path)).select("key", F.length("raw").alias("n"))


@query
def files_ranking(b):
    """cut, conf, miss, over of the ranking, through its CSV."""
    from kvern.plans.catalogue import _ranked

    path = scratch_path(b.spark)
    files.write_text_csv(_ranked(*b.stored()), path)
    back = files.text_csv(b.spark, path)
    return back.select("cut", F.col("conf").cast("double").alias("conf"), F.col("miss").cast("bigint").alias("miss"), F.col("over").cast("bigint").alias("over"))


@query
def queue_replace(b):
    """doc_no, n: what the sink holds after two batches, the second of which replaces and clears documents."""
    path = scratch_path(b.spark)
    write = queue.replace_documents(path, 8)
    box = F.struct("side", "x0", "y0", "x1", "y1")
    docs = b.preds.where("kilde = 'yolo'").groupBy("doc_no").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    write(docs, 0)
    again = docs.where("doc_no % 3 <> 0").withColumn("boxes", F.when(F.col("doc_no") % 3 == 1, F.slice("boxes", 1, 0)).otherwise(F.slice("boxes", 1, 2)))
    write(again, 1)
    write(again, 2)
    return queue.stored_boxes(b.spark, path).select("doc_no", F.size(F.from_json("value", "boxes array<struct<side:int>>")["boxes"]).alias("n"))


@query
def png_headers(b):
    """doc_no, side, width, height read from PNG headers made of the page sizes."""
    pages = b.table("resultat").where("navn is not null and side is not null").groupBy("navn", "side").agg(F.min("bilde_bredde").alias("w"), F.min("bilde_hoyde").alias("h"))
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    made = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word("w"), word("h"), F.lit("0802000000")))
    return pages.where("w is not null and h is not null").select("navn", "side", files.png_size(made).alias("s")).select("navn", "side", "s.width", "s.height")


@query
def poisson_bounds(b):
    """k, upper: the bound for each count of verdicts of nei per document."""
    k = b.judged.where("svar = 'nei'").groupBy("doc_no").agg(F.count(F.lit(1)).alias("k")).select("k").distinct()
    return k.select("k", F.round(scalar.poisson_upper_udf("k"), 4).alias("upper"))


@query
def sql_functions(b):
    """n of what the registered SQL functions find in the OCR texts."""
    numbers.register(b.spark)
    b.table("manifest").select("nr", "ocr_tekst").distinct().createOrReplaceTempView("kvern_texts")
    return b.spark.sql("select count_if(size(find_fnr(ocr_tekst)) > 0) as with_fnr, count_if(valid_orgnr(regexp_extract(ocr_tekst, '([0-9]{9})', 1))) as orgnr, count_if(parse_answer(ocr_tekst).svar = 'nei') as nei from kvern_texts")
