"""Training sets from documents: holdout pools, strategies, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.operators.sampling import quota_split
from kvern.session import materialize


def _key(seed: int):
    return F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed))))


def _ranked(docs: DataFrame, group: str) -> DataFrame:
    """docs (with key) and r: the place in the group by key; ranks run within leading hash bytes, whose offsets are sums of few numbers."""
    keyed = docs.withColumn("head", F.substring("key", 1, 2))
    sizes = keyed.groupBy(group, "head").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.withColumn("b", F.coalesce(F.sum("k").over(Window.partitionBy(group).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inner = keyed.withColumn("i", F.row_number().over(Window.partitionBy(group, "head").orderBy("key")))
    return inner.join(before, [group, "head"]).withColumn("r", F.col("b") + F.col("i")).drop("head", "b", "i")


def stratified_take(docs: DataFrame, strata: str, take: int, seed: int) -> DataFrame:
    """docs with taken: in each stratum the first round(size * take / all) by hash."""
    keyed = materialize(docs.withColumn("stratum", F.coalesce(F.col(strata).cast("string"), F.lit("ukjent"))).withColumn("key", _key(seed)))
    sizes = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quota = sizes.join(total).select("stratum", F.bround(F.col("n") * float(take) / F.col("total")).cast("bigint").alias("quota"))
    return _ranked(keyed, "stratum").join(quota, "stratum").withColumn("taken", F.col("r") <= F.col("quota")).select(*docs.columns, "taken")


def holdout_pools(labelled: DataFrame, meta: DataFrame, share: float, neg_holdout: int, neg_train: int, forced: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """doc_no, pool: holdout, train, holdout negative, train negative; labelled documents outside the metadata and further negatives are in none.

    Per decade the labelled documents are split by share, forced ones always to train; the documents without labels give
    neg_holdout and then neg_train negatives, drawn per decade as well.
    """
    docs = meta.select("doc_no", "decade").distinct()
    seen = labelled.select("doc_no").distinct().withColumn("l", F.lit(True))
    must = (forced.select("doc_no").distinct() if forced is not None else docs.select("doc_no").limit(0)).withColumn("f", F.lit(True))
    marked = materialize(docs.join(seen, "doc_no", "left").join(must, "doc_no", "left").na.fill(False, ["l", "f"]))
    free = marked.where("l and not f")
    held = materialize(stratified_take(free, "decade", _half_even(free.count() * share), seed))
    negatives = marked.where("not l and not f")
    n_held = min(neg_holdout, negatives.count())
    first = materialize(stratified_take(negatives, "decade", n_held, seed + 1))
    rest = first.where("not taken").drop("taken")
    second = stratified_take(rest, "decade", min(neg_train, rest.count()), seed + 2)
    pool = lambda df, name: df.select("doc_no", F.lit(name).alias("pool"))
    return (
        pool(held.where("taken"), "holdout").union(pool(held.where("not taken"), "train")).union(pool(marked.where("l and f"), "train"))
        .union(pool(first.where("taken"), "holdout negative")).union(pool(second.where("taken"), "train negative"))
    )


def _half_even(x: float) -> int:
    return round(x)


def with_negatives(positives: DataFrame, negatives: DataFrame, weight: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """doc_no, weight, split of the positives (with split), and of negative documents in hash order: to each split in turn until it has ratio times its positive weight."""
    parts = {r["split"]: r["w"] for r in positives.groupBy("split").agg(F.sum(weight).alias("w")).collect()}
    keyed = negatives.select("doc_no", F.col(weight).cast("bigint").alias("weight")).withColumn("key", _key(seed)).withColumn("head", F.substring("key", 1, 2))
    sizes = keyed.groupBy("head").agg(F.sum("weight").alias("w"))
    heads = sizes.withColumn("b", F.coalesce(F.sum("w").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("w")
    run = materialize(keyed.join(heads, "head").withColumn("upto", F.col("b") + F.sum("weight").over(Window.partitionBy("head").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))).select("doc_no", "weight", "upto"))
    out = positives.select("doc_no", F.col(weight).cast("bigint").alias("weight"), "split")
    start = 0
    for split in ("train", "val", "test"):
        target = int(parts.get(split, 0) * ratio)
        if not target:
            continue
        end = run.where(F.col("upto") >= start + target).agg(F.min("upto")).first()[0] or run.agg(F.max("upto")).first()[0] or start
        out = out.union(run.where((F.col("upto") > start) & (F.col("upto") <= end)).select("doc_no", "weight", F.lit(split).alias("split")))
        start = end
    return out


def strategy_split(docs: DataFrame, cond, weight: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """quota_split of the documents that meet a condition (a year range, a document type, both)."""
    return quota_split(docs.where(cond), weight, train, val, seed)


def pages_without_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_no, side of the rendered pages of labelled and unlabelled documents that hold no label: the negatives of a dataset."""
    return pages.select("doc_no", "side").distinct().join(labels.select("doc_no", "side").distinct(), ["doc_no", "side"], "left_anti")
