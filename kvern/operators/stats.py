"""Reports over labels, matches, verdicts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.session import materialize


def share(a, b, digits: int = 6):
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), digits)


def count_where(cond):
    return F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))


# ----- evaluation against truth

def eval_overall(matches: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: truth, hit, recall, overlap (areas), pred, surplus (predictions that are no truth's hit)."""
    m = matches.agg(F.count(F.lit(1)).alias("truth"), count_where(F.col("hit")).alias("hit"), F.sum("overlap").alias("ov"), F.sum("truth_area").alias("fa"))
    used = matches.where("hit").select("pred_id").distinct().agg(F.count(F.lit(1)).alias("used"))
    p = preds.agg(F.count(F.lit(1)).alias("pred"))
    return m.join(p).join(used).select(F.col("truth"), F.coalesce("hit", F.lit(0)).alias("hit"), share(F.col("hit"), F.col("truth")).alias("recall"), share(F.col("ov"), F.col("fa")).alias("overlap"), "pred", (F.col("pred") - F.col("used")).alias("surplus"))


def eval_per_type(matches: DataFrame) -> DataFrame:
    return matches.groupBy("type").agg(F.count(F.lit(1)).alias("truth"), count_where(F.col("hit")).alias("hit")).withColumn("recall", share(F.col("hit"), F.col("truth")))


def eval_per_source(matches: DataFrame, preds: DataFrame) -> DataFrame:
    """kilde, n, hit, surplus: boxes, not truths, so a box that hits several truths counts once."""
    used = matches.where("hit").select("pred_id").distinct().withColumn("used", F.lit(True))
    rows = preds.select("pred_id", "kilde").join(used, "pred_id", "left").groupBy("kilde").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("used")).alias("hit"))
    return rows.select("kilde", "n", "hit", (F.col("n") - F.col("hit")).alias("surplus"))


def eval_miss_pages(matches: DataFrame) -> DataFrame:
    """doc_no, side, missed, total of each page with a missed truth box."""
    return matches.groupBy("doc_no", "side").agg(count_where(~F.col("hit")).alias("missed"), F.count(F.lit(1)).alias("total")).where("missed > 0")


def run_stats(matches: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: mean and median coverage in percent, mean over hits, precision, pages and documents."""
    cov = F.round(F.col("cov") * 100, 1)
    a = matches.agg(F.round(F.avg(cov), 4).alias("cov_mean"), F.round(F.percentile(cov, F.lit(0.5)), 4).alias("cov_median"), F.round(F.avg(F.when(F.col("hit"), cov)), 4).alias("cov_mean_hit"), F.count_distinct("doc_no").alias("docs"), F.count_distinct("doc_no", "side").alias("pages"))
    o = eval_overall(matches, preds).select(F.round(F.when(F.col("pred") > 0, 1 - F.col("surplus") / F.col("pred")).otherwise(0.0), 6).alias("precision"))
    return a.join(o)


def worst_files(matches: DataFrame, n: int = 15) -> DataFrame:
    """The n documents with most missed truth boxes."""
    per = matches.groupBy("doc_no").agg(count_where(~F.col("hit")).alias("missed"), F.count(F.lit(1)).alias("total"))
    return per.where("missed > 0").orderBy(F.desc("missed"), F.desc("total"), F.desc("doc_no")).limit(n)


# ----- labels

def label_outcomes(labels: DataFrame) -> DataFrame:
    """type (and SUM), tp, fp, moved, fn, unresolved, recall, precision of the labels' own history; a moved box is a miss."""
    ml, s = F.col("ml"), F.col("status")
    rows = labels.rollup("type").agg(
        count_where(ml & (s == "ACCEPTED")).alias("tp"), count_where(ml & (s == "REJECTED")).alias("fp"), count_where(ml & (s == "MOVED")).alias("moved"), count_where(~ml).alias("fn"),
        count_where(ml & ~s.isin("ACCEPTED", "REJECTED", "MOVED")).alias("unresolved"), F.count(F.lit(1)).alias("n"),
    ).where("n > 0")
    c = F.col
    pred = c("tp") + c("fp") + c("moved")
    return rows.select(F.coalesce("type", F.lit("SUM")).alias("type"), "tp", "fp", "moved", "fn", "unresolved", share(c("tp"), c("tp") + c("fn") + c("moved")).alias("recall"), F.round(F.when(pred > 0, 1 - c("fp") / pred).otherwise(0.0), 6).alias("precision"))


def boxes_per_document(labels: DataFrame) -> DataFrame:
    """n_boxes, n_docs: how many documents have how many boxes."""
    return labels.groupBy("doc_no").agg(F.count(F.lit(1)).alias("n_boxes")).groupBy("n_boxes").agg(F.count(F.lit(1)).alias("n_docs"))


def page_share(labels: DataFrame) -> DataFrame:
    """One row: n, docs, share of page 1 and of pages 1 to 3, highest page, upper median, most boxes in a document and that document.

    The upper median comes from the counts of counts, not from a sorted list of documents.
    """
    per = labels.groupBy("doc_no").agg(F.count(F.lit(1)).alias("k"))
    top = per.agg(F.max("k").alias("most"), F.max_by("doc_no", F.struct(F.col("k"), -F.col("doc_no"))).alias("most_doc"), F.count(F.lit(1)).alias("docs"))
    dist = boxes_per_document(labels)
    upto = Window.orderBy("n_boxes").rowsBetween(Window.unboundedPreceding, 0)
    middle = dist.withColumn("c", F.sum("n_docs").over(upto)).join(top.select("docs")).where(F.col("c") > F.floor(F.col("docs") / 2)).agg(F.min("n_boxes").alias("upper_median"))
    base = labels.agg(F.count(F.lit(1)).alias("n"), count_where(F.col("side") == 1).alias("p1"), count_where(F.col("side").between(1, 3)).alias("p3"), F.max("side").alias("highest_page"))
    return base.join(top).join(middle).select("n", "docs", share(F.col("p1"), F.col("n")).alias("page1_share"), share(F.col("p3"), F.col("n")).alias("page123_share"), "highest_page", "upper_median", "most", "most_doc")


def status_crosstab(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.when(F.col("ml"), "ml").otherwise("manual").alias("who"), F.when(F.col("status") == "", "(empty)").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def position_density(labels: DataFrame, bins: int = 30, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """bx, by, n: box centres on a square grid of an A4 page."""
    cut = lambda c, size: F.floor(c * bins / size).cast("int")
    return labels.groupBy(cut((F.col("x0") + F.col("x1")) / 2, width).alias("bx"), cut((F.col("y0") + F.col("y1")) / 2, height).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def size_summary(labels: DataFrame) -> DataFrame:
    """type, n, sums and spread of the widths, and outliers' bound."""
    w = F.col("x1") - F.col("x0")
    return labels.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(w), 2).alias("w_sum"), F.round(F.avg(w), 4).alias("w_mean"), F.round(F.stddev_samp(w), 4).alias("w_std"), F.round(F.min(w), 4).alias("w_min"), F.round(F.max(w), 4).alias("w_max"))


def largest_labels(labels: DataFrame, n: int = 15) -> DataFrame:
    a = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 4)
    return labels.select("label_id", "doc_no", "side", a.alias("area")).orderBy(F.desc("area"), "label_id").limit(n)


def ordered_values(values: DataFrame, groups: list[str], indices) -> DataFrame:
    """groups, _k, n, value: the value at each 0-based index (a Column of n for each k in indices) of each group's sorted values.

    Equal values are counted, the counts range-sorted over all groups, and ranks found from sums per range, so no task
    holds a group's values and only the ranges that hold an index are sorted. values: groups and `value`, nulls left out.
    """
    counts = values.where("value is not null").groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialize(counts.repartitionByRange(*groups, "value").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("_c").alias("_c"))
    inside = Window.partitionBy(*groups).orderBy("_part")
    places = parts.withColumn("_upto", F.sum("_c").over(inside)).withColumn("n", F.sum("_c").over(Window.partitionBy(*groups)))
    wanted = places.select(*groups, "_part", "n", "_upto", (F.col("_upto") - F.col("_c")).alias("_before"), F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.least(F.greatest(i(F.col("n")).cast("bigint"), F.lit(0)), F.col("n") - 1).alias("_at")) for k, i in indices.items()])).alias("w"))
    wanted = wanted.select(*groups, "_part", "n", "_before", "_upto", "w.*").where("_at >= _before and _at < _upto")
    # only the ranges that hold a wanted index are read again
    held = ranged.join(wanted.select(*groups, "_part", "_before").distinct(), [*groups, "_part"])
    run = held.withColumn("_last", F.col("_before") + F.sum("_c").over(Window.partitionBy(*groups, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.col("_last") - F.col("_c"))
    on = [*groups, "_part"]
    found = wanted.select(*on, "_k", "n", "_at").join(run.select(*on, "value", "_first", "_last"), on).where("_at >= _first and _at < _last")
    return found.select(*groups, "_k", "n", "value")


def linear_percentiles(values: DataFrame, groups: list[str], points) -> DataFrame:
    """groups, n, q, value: percentiles with linear interpolation between the two neighbouring values, exact."""
    low = {f"l{i}": (lambda n, q=q: F.floor((n - 1) * q)) for i, q in enumerate(points)}
    high = {f"h{i}": (lambda n, q=q: F.ceil((n - 1) * q)) for i, q in enumerate(points)}
    at = ordered_values(values, groups, low | high)
    rows = at.groupBy(*groups, "n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "value"))).alias("v"))
    flat = F.array(*[F.struct(F.lit(q).alias("q"), F.col("v")[f"l{i}"].alias("a"), F.col("v")[f"h{i}"].alias("b"), ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)).alias("_part")) for i, q in enumerate(points)])
    out = rows.select(*groups, "n", F.explode(flat).alias("r")).select(*groups, "n", "r.*")
    return out.select(*groups, "n", "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_part")).alias("value"))


def shape_percentiles(classified: DataFrame, least: int = 20, points=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """kilde, klasse, n, measure, q, value: linear percentiles of groups with enough boxes."""
    measures = ("elongation", "short_side", "long_side", "area")
    long = classified.select("kilde", "klasse", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])).alias("m")).select("kilde", "klasse", "m.*")
    rows = linear_percentiles(long, ["kilde", "klasse", "measure"], points)
    return rows.where(F.col("n") >= least).select("kilde", "klasse", "n", "measure", "q", F.round("value", 6).alias("value"))


def index_percentiles(df: DataFrame, group: str, value: str, points=(5, 25, 50, 75, 95)) -> DataFrame:
    """group, n, and by three index rules (0-based): int(n p / 100) capped, int(p (n - 1) / 100), and n // 2."""
    rules = {f"a{p}": (lambda n, p=p: F.least(F.floor(n * p / 100), n - 1)) for p in points} | {f"b{p}": (lambda n, p=p: F.floor((n - 1) * p / 100)) for p in points} | {"upper_median": lambda n: F.floor(n / 2)}
    at = ordered_values(df.select(group, F.col(value).alias("value")), [group], rules)
    rows = at.groupBy(group, "n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "value"))).alias("v"))
    return rows.select(group, "n", *[F.col("v")[k].alias(k) for k in rules])


# ----- documents

def code_density(meta: DataFrame, classified: DataFrame, cover: DataFrame) -> DataFrame:
    """code, docs, run, truth, hit, lost, bom and bom per source for each document-type code; '(none)' for documents in scope without metadata.

    An oversized box counts as neither hit nor bom.
    """
    bom = lambda k: count_where((F.col("klasse") == "BOM") & (F.col("kilde") == k)).alias(f"bom_{k}")
    per_p = classified.groupBy("doc_no").agg(count_where(F.col("klasse") == "TREFF").alias("hit"), count_where(F.col("klasse") == "BOM").alias("bom"), bom("begge"), bom("yolo"), bom("paddle"))
    per_t = cover.groupBy("doc_no").agg(F.count(F.lit(1)).alias("truth"), count_where(F.col("n_coverers") == 0).alias("lost"))
    docs = per_p.join(per_t, "doc_no", "full").withColumn("ran", F.lit(1))
    coded = meta.select("doc_no", F.explode_outer("codes").alias("code")).where("code is not null")
    known = coded.join(docs, "doc_no", "left")
    unknown = docs.join(meta.select("doc_no"), "doc_no", "left_anti").withColumn("code", F.lit("(none)"))
    names = ["ran", "truth", "hit", "lost", "bom", "bom_begge", "bom_yolo", "bom_paddle"]
    rows = known.select("code", *names).unionByName(unknown.select("code", *names))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("docs"), *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def per_electronic(meta: DataFrame, cover: DataFrame) -> DataFrame:
    """electronic, docs, truth, lost."""
    per = cover.groupBy("doc_no").agg(F.count(F.lit(1)).alias("truth"), count_where(F.col("n_coverers") == 0).alias("lost"))
    return meta.join(per, "doc_no").groupBy("electronic").agg(F.count(F.lit(1)).alias("docs"), F.sum("truth").alias("truth"), F.sum("lost").alias("lost"))


def documents_per_year(meta: DataFrame, labels: DataFrame) -> DataFrame:
    """year, docs, labelled, boxes, pages."""
    per = labels.groupBy("doc_no").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("side").alias("pages"))
    return meta.join(per, "doc_no", "left").groupBy("year").agg(F.count(F.lit(1)).alias("docs"), F.count("boxes").alias("labelled"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def unreviewed(meta: DataFrame, preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with predictions that have neither labels nor the processed mark."""
    return preds.select("doc_no").distinct().join(labels.select("doc_no"), "doc_no", "left_anti").join(meta.where("processed").select("doc_no"), "doc_no", "left_anti")


def without_profile(meta: DataFrame, preds: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Documents with predictions and none of the codes; documents without metadata are included."""
    flagged = meta.where(F.arrays_overlap("codes", F.array(*map(F.lit, codes)))).select("doc_no")
    return preds.select("doc_no").distinct().join(flagged, "doc_no", "left_anti")


# ----- verdicts

def verdict_confusion(judged: DataFrame) -> DataFrame:
    """klasse (and SUM), ja, nei, n, by one rollup."""
    rows = judged.rollup("klasse").agg(count_where(F.col("svar") == "ja").alias("ja"), count_where(F.col("svar") == "nei").alias("nei"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return rows.withColumn("klasse", F.coalesce("klasse", F.lit("SUM")))


def verdict_split(judged: DataFrame, column: str = "kilde") -> DataFrame:
    """value, bom_nei, bom, dek_nei, dek and shares of nei per value of a column; blank is '(empty)'."""
    value = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("(empty)"))
    on = lambda g, nei: count_where((F.col("gruppe") == g) & ((F.col("svar") == "nei") | F.lit(not nei)))
    rows = judged.groupBy(value.alias("value")).agg(on("BOM", True).alias("bom_nei"), on("BOM", False).alias("bom"), on("DEKKENDE", True).alias("dek_nei"), on("DEKKENDE", False).alias("dek"))
    return rows.withColumn("bom_share", share(F.col("bom_nei"), F.col("bom"))).withColumn("dek_share", share(F.col("dek_nei"), F.col("dek")))


def verdict_tally(judged: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: judged counts, factors to the whole manifest, gain, loss and its upper bound at 95 %."""
    from kvern.functions.scalar import poisson_upper_udf

    on = lambda g, nei: count_where((F.col("gruppe") == g) & ((F.col("svar") == "nei") | F.lit(not nei)))
    t = judged.agg(on("BOM", False).alias("n_bom"), on("BOM", True).alias("n_bom_nei"), on("DEKKENDE", False).alias("n_dek"), on("DEKKENDE", True).alias("n_dek_nei"))
    m = manifest.agg(count_where(F.col("gruppe") == "BOM").alias("bom_total"), count_where(F.col("gruppe") == "DEKKENDE").alias("dek_total"))
    c = F.col
    f = t.join(m).withColumn("bom_factor", F.when((c("bom_total") > 0) & (c("n_bom") > 0), c("bom_total") / c("n_bom")).otherwise(1.0)).withColumn("dek_factor", F.when((c("dek_total") > 0) & (c("n_dek") > 0), c("dek_total") / c("n_dek")).otherwise(1.0))
    return f.select(
        "n_bom", "n_bom_nei", "n_dek", "n_dek_nei", F.round("bom_factor", 6).alias("bom_factor"), F.round("dek_factor", 6).alias("dek_factor"), F.round(c("n_bom_nei") * c("bom_factor"), 4).alias("gain"),
        F.round(c("n_dek_nei") * c("dek_factor"), 4).alias("loss"), F.round(poisson_upper_udf("n_dek_nei") * c("dek_factor"), 4).alias("loss_upper"),
    )


def hard_documents(judged: DataFrame, n: int = 20) -> DataFrame:
    """The n documents with most wrong verdicts: nei on a covering box, ja on one that covers nothing."""
    wrong = judged.where(((F.col("gruppe") == "BOM") & (F.col("svar") == "ja")) | ((F.col("gruppe") == "DEKKENDE") & (F.col("svar") == "nei")))
    return wrong.where("doc_no is not null").groupBy("doc_no").agg(F.count(F.lit(1)).alias("wrong")).orderBy(F.desc("wrong"), "doc_no").limit(n)


def skewed_sample(judged: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: shares of BOM in manifest and judged rows, and whether the judged ones look unlike a random sample."""
    a = judged.agg(F.count(F.lit(1)).alias("n"), count_where(F.col("gruppe") == "BOM").alias("b"))
    m = manifest.agg(F.count(F.lit(1)).alias("n_all"), count_where(F.col("gruppe") == "BOM").alias("b_all"))
    r = a.join(m).select("n", "n_all", share(F.col("b"), F.col("n")).alias("judged_bom"), share(F.col("b_all"), F.col("n_all")).alias("manifest_bom"))
    return r.withColumn("skewed", (F.col("n") > 0) & (F.col("n") < 0.9 * F.col("n_all")) & (F.col("manifest_bom") > 0) & (F.abs(F.col("judged_bom") - F.col("manifest_bom")) > 0.15))


# ----- review orders

def page_triage(classified: DataFrame) -> DataFrame:
    """doc_no, side, n, prio, rank of pages with BOM boxes: most important source first, then most boxes.

    Pages are ranked within priority and count classes; classes are few, so their offsets come from one small window.
    """
    prio = F.when(F.col("kilde") == "begge", 0).when(F.col("kilde") == "yolo", 1).when(F.col("kilde") == "paddle", 2).otherwise(9)
    pages = classified.where("klasse = 'BOM'").groupBy("doc_no", "side").agg(F.min(prio).alias("prio"), F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("prio", "n").agg(F.count(F.lit(1)).alias("pages"))
    before = sizes.withColumn("before", F.coalesce(F.sum("pages").over(Window.orderBy("prio", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("prio", "n").orderBy("doc_no", "side"))
    return pages.withColumn("r", inside).join(before.select("prio", "n", "before"), ["prio", "n"]).select("doc_no", "side", "n", "prio", (F.col("before") + F.col("r")).alias("rank"))


def band_review(pairs: DataFrame, low: float, high: float, metric: str = "cov_area") -> DataFrame:
    """label_id, pred_id, value, tips: pairs with the metric in [low, high); tips says that no other pair of the truth is at or above high."""
    saved = pairs.where(F.col(metric) >= high).select("label_id").distinct().withColumn("saved", F.lit(True))
    band = pairs.where((F.col(metric) >= low) & (F.col(metric) < high))
    return band.join(saved, "label_id", "left").select("label_id", "pred_id", F.round(metric, 6).alias("value"), F.col("saved").isNull().alias("tips"))


def removal_kinds(classified: DataFrame, edges: DataFrame, removed) -> DataFrame:
    """pred_id, kind of each removed box: surplus, critical (some truth loses its last coverer) or redundant."""
    marked = classified.withColumn("gone", removed)
    kept = edges.join(marked.select("pred_id", "gone"), "pred_id").groupBy("label_id").agg(F.bool_and("gone").alias("lost"))
    critical = edges.join(kept.where("lost"), "label_id").select("pred_id").distinct().withColumn("c", F.lit(True))
    kind = F.when(F.col("klasse") == "BOM", "surplus").when(F.col("c"), "critical").otherwise("redundant")
    return marked.where("gone").join(critical, "pred_id", "left").select("pred_id", "doc_no", "side", kind.alias("kind"))
