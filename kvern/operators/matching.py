"""Prediction x truth on a page, by spatial criterion; classes and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.geometry import CRITERIA, Box, area, intersection_area, pair_metrics, passes
from kvern.operators.views import A4

# Part of a truth box that must be covered, and how much larger than its truth a prediction may be.
THRESHOLD, OVERSIZE = 0.32, 3.0
#: Horizontal strips of a page; both sides of the join carry them, so that a page with very many boxes is many small groups.
STRIPS = 24


def truth_boxes(labels: DataFrame, pages: DataFrame, excluded=("REJECTED",)) -> DataFrame:
    """Truth in scope: rows of label_rows on documents with predictions, less the excluded statuses, with n* relative to the page and `horizontal`.

    pages: doc_no, side, pw, ph of every page with predictions (views.page_sizes); another page takes the size of A4.
    """
    kept = labels.where(~F.col("status").isin(*excluded)) if excluded else labels
    scoped = kept.join(pages.select("doc_no").distinct(), "doc_no", "left_semi").join(pages, ["doc_no", "side"], "left")
    norm = Box.of().scaled(F.coalesce("pw", F.lit(A4[0])), F.coalesce("ph", F.lit(A4[1])))
    cols = scoped.select("*", *[c.alias("n" + n) for n, c in zip(Box._fields, norm)], ((F.col("x1") - F.col("x0")) >= (F.col("y1") - F.col("y0"))).alias("horizontal"))
    return cols.withColumn("norm_area", area(Box.of("n"))).drop("pw", "ph")


def _strips(df: DataFrame, name: str) -> DataFrame:
    low, high = (F.floor(c * STRIPS).cast("int") for c in (F.least("ny0", "ny1"), F.greatest("ny0", "ny1")))
    clip = lambda c: F.least(F.lit(STRIPS), F.greatest(F.lit(-1), c))
    return df.withColumn(name, clip(low)).withColumn("strip", F.explode(F.sequence(clip(low), clip(high))))


def overlapping_pairs(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """pred_id, label_id, both areas and the six pair metrics of every overlapping pair on a page.

    A pair that shares several strips is kept in the first of them only.
    """
    p = _strips(preds.select("pred_id", "doc_no", "side", "nx0", "ny0", "nx1", "ny1", F.col("norm_area").alias("pred_area")), "first_p").alias("p")
    t = _strips(truth.where("norm_area > 0").select("label_id", "doc_no", "side", "nx0", "ny0", "nx1", "ny1", "horizontal", F.col("norm_area").alias("truth_area")), "first_t").alias("t")
    both = p.join(t, ["doc_no", "side", "strip"]).where(F.col("strip") == F.greatest("first_p", "first_t"))
    pb, tb = Box.of("p.n"), Box.of("t.n")
    hit = both.where(intersection_area(pb, tb) > 0)
    return hit.select("pred_id", "label_id", "pred_area", "truth_area", intersection_area(pb, tb).alias("overlap"), *[c.alias(n) for n, c in pair_metrics(pb, tb, F.col("t.horizontal")).items()])


def covers(pairs: DataFrame, criterion: str = "area", threshold: float = THRESHOLD) -> DataFrame:
    """Edges pred_id, label_id, truth_area of the pairs that meet the criterion."""
    return pairs.where(passes(criterion, threshold)).select("pred_id", "label_id", "truth_area")


def classify(preds: DataFrame, edges: DataFrame, oversize: float = OVERSIZE) -> DataFrame:
    """Predictions with n_covers and klasse: BOM covers no truth, SLURV is oversize x larger than what it covers, else TREFF."""
    per = edges.groupBy("pred_id").agg(F.count(F.lit(1)).alias("n_covers"), F.sum("truth_area").alias("covered_area"))
    joined = preds.join(per, "pred_id", "left")
    klasse = F.when(F.col("n_covers").isNull(), "BOM").when(F.col("norm_area") > oversize * F.col("covered_area"), "SLURV").otherwise("TREFF")
    return joined.withColumn("klasse", klasse).withColumn("n_covers", F.coalesce("n_covers", F.lit(0)).cast("bigint")).drop("covered_area")


def class_summary(classified: DataFrame) -> DataFrame:
    """kilde, n, treff, slurv, bom, bom_pct per source and for all (SUM), by one rollup."""
    count = lambda k: F.sum((F.col("klasse") == k).cast("bigint"))
    rows = classified.rollup("kilde").agg(F.count(F.lit(1)).alias("n"), count("TREFF").alias("treff"), count("SLURV").alias("slurv"), count("BOM").alias("bom"))
    return rows.where("n > 0").select(F.coalesce("kilde", F.lit("SUM")).alias("kilde"), "n", "treff", "slurv", "bom", F.round(F.col("bom") * 100.0 / F.col("n"), 4).alias("bom_pct"))


def coverage(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """label_id, doc_no, side, type, n_coverers of every truth box."""
    per = edges.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_coverers"))
    return truth.join(per, "label_id", "left").select("label_id", "doc_no", "side", "type", F.coalesce("n_coverers", F.lit(0)).cast("bigint").alias("n_coverers"))


def best_matches(preds: DataFrame, truth: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each truth box with the prediction of largest overlap (the smallest id on ties): label_id, doc_no, side, type, truth_area, pred_id, kilde, conf, overlap, cov, hit."""
    best = pairs.groupBy("label_id").agg(F.min_by(F.struct("pred_id", "overlap", "cov_area"), F.struct(-F.col("overlap"), "pred_id")).alias("b")).select("label_id", "b.*")
    named = best.join(preds.select("pred_id", "kilde", "conf"), "pred_id")
    rows = truth.select("label_id", "doc_no", "side", "type", F.col("norm_area").alias("truth_area")).join(named, "label_id", "left")
    return rows.select("label_id", "doc_no", "side", "type", "truth_area", "pred_id", "kilde", "conf", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("cov_area", F.lit(0.0)).alias("cov"), (F.coalesce("cov_area", F.lit(0.0)) >= threshold).alias("hit"))


def threshold_curve(preds: DataFrame, pairs: DataFrame, n_truth: int | None, thresholds, criterion: str = "area") -> DataFrame:
    """threshold, covered, bom: how many truth boxes are covered and predictions cover none, from one pass over the pairs.

    A truth box counts as covered up to the best value of its pairs, and so does a prediction, so nothing is matched again.
    """
    name, low = CRITERIA[criterion]
    best = F.min if low else F.max
    per_truth = pairs.groupBy("label_id").agg(best(name).alias("v")).select("v", F.lit("t").alias("side_of"))
    per_pred = pairs.groupBy("pred_id").agg(best(name).alias("v")).select("v", F.lit("p").alias("side_of"))
    sums = []
    for i, t in enumerate(thresholds):
        ok = F.col("v") <= t if low else F.col("v") >= t
        sums += [F.sum((ok & (F.col("side_of") == "t")).cast("bigint")).alias(f"t{i}"), F.sum((ok & (F.col("side_of") == "p")).cast("bigint")).alias(f"p{i}")]
    one = per_truth.union(per_pred).agg(*sums)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("covered"), F.col(f"p{i}").alias("covering")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")
    total = preds.agg(F.count(F.lit(1)).alias("n_pred"))
    return rows.join(total).select("threshold", F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("n_pred") - F.coalesce("covering", F.lit(0))).alias("bom"))


def criterion_states(preds: DataFrame, truth: DataFrame, pairs: DataFrame, first: tuple[str, float], second: tuple[str, float]) -> tuple[DataFrame, DataFrame]:
    """(truth, class) crosstabs of two criteria: covered_a, covered_b, n and klasse_a, klasse_b, n."""
    a, b = (covers(pairs, *c) for c in (first, second))
    ta, tb = (e.select("label_id").distinct().withColumn(f"c{i}", F.lit(True)) for i, e in enumerate((a, b)))
    states = truth.select("label_id").join(ta, "label_id", "left").join(tb, "label_id", "left")
    on_truth = states.groupBy(F.coalesce("c0", F.lit(False)).alias("covered_a"), F.coalesce("c1", F.lit(False)).alias("covered_b")).agg(F.count(F.lit(1)).alias("n"))
    ka, kb = (classify(preds, e).select("pred_id", F.col("klasse").alias(f"klasse_{x}")) for x, e in (("a", a), ("b", b)))
    on_class = ka.join(kb, "pred_id").groupBy("klasse_a", "klasse_b").agg(F.count(F.lit(1)).alias("n"))
    return on_truth, on_class


def cut_confidence():
    return F.coalesce("conf", F.lit(1.0))


def confidence_points(classified: DataFrame, edges: DataFrame, truth: DataFrame, cost: float = 5.0, most_points: int = 400, standard: float = 0.5) -> DataFrame:
    """conf, miss, over, total for the confidence cuts that occur: truths without a coverer at or above it, and BOM boxes at or above it.

    A box without a confidence (other sources than the detector) survives every cut. Values are rounded to four decimals,
    so there are at most 10 001 of them at any data size; beyond `most_points` those at int(i * step) are kept, as the
    report wants, and the standard cut always.
    """
    conf = cut_confidence()
    top = edges.join(classified.select("pred_id", conf.alias("c")), "pred_id").groupBy("label_id").agg(F.max("c").alias("v"))
    kinds = top.select("v", F.lit(1).alias("is_truth")).union(classified.where("klasse = 'BOM'").select(conf.alias("v"), F.lit(0).alias("is_truth")))
    # a value is below the cut it rounds to, or at it; with at most 10 001 cuts there are twice as many groups
    cut = F.round("v", 4)
    exact = kinds.groupBy(cut.alias("at"), F.when(F.col("v") < cut, -1).otherwise(1).alias("order")).agg(F.sum("is_truth").alias("t"), F.sum(1 - F.col("is_truth")).alias("b"))
    cuts = exact.where("at >= 0").select(F.col("at").alias("conf")).union(classified.sparkSession.createDataFrame([(standard,)], "conf double")).distinct()
    events = exact.select("at", "order", "t", "b").union(cuts.select(F.col("conf").alias("at"), F.lit(0).alias("order"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    below = Window.orderBy("at", "order").rowsBetween(Window.unboundedPreceding, -1)
    sums = exact.agg(F.sum("t").alias("all_t"), F.sum("b").alias("all_b"))
    n_truth = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    swept = events.select("at", "order", F.coalesce(F.sum("t").over(below), F.lit(0)).alias("t_below"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b_below")).where("order = 0")
    ranked = swept.withColumn("r", F.row_number().over(Window.orderBy("at")) - 1).withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    step = F.col("n_points") / float(most_points)
    picked = F.exists(F.sequence(F.lit(0), F.lit(most_points - 1)), lambda i: F.floor(i * step) == F.col("r"))
    kept = ranked.where((F.col("n_points") <= most_points) | (F.col("at") == standard) | picked)
    rows = kept.join(sums).join(n_truth)
    miss = F.col("n_truth") - F.col("all_t") + F.col("t_below")
    over = F.col("all_b") - F.col("b_below")
    return rows.select(F.col("at").alias("conf"), miss.alias("miss"), over.alias("over"), (cost * miss + over).alias("total"))


def cut_slices(classified: DataFrame, edges: DataFrame, truth: DataFrame, meta: DataFrame, cuts: DataFrame) -> DataFrame:
    """cut, conf, part, value, n_truth, miss, worst: misses at each row of cuts (cut, conf) on manual and moved truth, per decade and per code.

    A document with several codes counts under each; without a decade or a code it is "unknown". worst marks the decade,
    and the known code, of most misses (the first by name on ties); nothing is worst where nothing is missed.
    """
    top = edges.join(classified.select("pred_id", cut_confidence().alias("c")), "pred_id").groupBy("label_id").agg(F.max("c").alias("v"))
    docs = meta.select("doc_no", F.col("decade").cast("string").alias("decade"), "codes")
    codes = F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("unknown")))
    part = lambda name, values: F.transform(values, lambda x: F.struct(F.lit(name).alias("part"), x.alias("value")))
    manual = F.when(~F.col("ml") | F.col("status").isin("MANUAL", "MOVED"), F.array(F.lit("manual"))).otherwise(F.expr("cast(array() as array<string>)"))
    parts = F.concat(part("manual", manual), part("decade", F.array(F.coalesce("decade", F.lit("unknown")))), part("code", codes))
    rows = truth.join(top, "label_id", "left").join(docs, "doc_no", "left").select("v", F.explode(parts).alias("p")).select("v", "p.*")
    counts = rows.join(F.broadcast(cuts.select("cut", "conf"))).groupBy("cut", "conf", "part", "value").agg(F.count(F.lit(1)).alias("n_truth"), F.count_if(F.col("v").isNull() | (F.col("v") < F.col("conf"))).alias("miss"))
    ranks = (F.col("part") != "manual") & (F.col("miss") > 0) & ~((F.col("part") == "code") & (F.col("value") == "unknown"))
    first = F.row_number().over(Window.partitionBy("cut", "part").orderBy(F.when(ranks, F.col("miss")).desc_nulls_last(), "value")) == 1
    return counts.withColumn("worst", ranks & first)
