"""Samples, slices and splits by hash order, the same on any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_percent(name):
    """md5(name) mod 100, exact: the 128-bit value in four 32-bit parts, as 2**32 mod 100 is 96."""
    h = F.md5(name)
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
    out = part(0)
    for i in (1, 2, 3):
        out = (out % 100) * 96 + part(i)
    return (out % 100).cast("int")


def hash_slice(df: DataFrame, name, pct: int) -> DataFrame:
    return df.where(hash_percent(name) < pct)


def asymmetric_sample(classified: DataFrame, n_covering: int, seed: int = 42) -> DataFrame:
    """pred_id, klasse, factor: every BOM box, and the n_covering covering boxes that come first by hash; factor scales a row to its whole class."""
    key = F.md5(F.concat_ws("|", F.col("pred_id").cast("string"), F.lit(str(seed))))
    covering = classified.where("klasse <> 'BOM'").select("pred_id", "klasse", key.alias("key")).orderBy("key").limit(n_covering).drop("key")
    n = classified.agg(F.count_if(F.col("klasse") != "BOM").alias("n"))
    drawn = covering.join(n).select("pred_id", "klasse", F.round(F.col("n") / F.least(F.col("n"), F.lit(n_covering)), 6).alias("factor"))
    return classified.where("klasse = 'BOM'").select("pred_id", "klasse", F.lit(1.0).alias("factor")).union(drawn)


def stratified_holdout(docs: DataFrame, strata: str, share: float, seed: int = 42) -> DataFrame:
    """doc_no, stratum, holdout: in each stratum the first round(n * share) documents by hash; documents without a stratum are one, 'ukjent'."""
    keyed = docs.select("doc_no", F.coalesce(F.col(strata).cast("string"), F.lit("ukjent")).alias("stratum")).distinct()
    keyed = keyed.withColumn("key", F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed)))))
    n = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # ranks within a stratum by leading hash byte: no task ranks more than a 256th of a hot stratum
    head = F.substring("key", 1, 2)
    keyed = keyed.withColumn("head", head)
    sizes = keyed.groupBy("stratum", "head").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("stratum").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "head").orderBy("key"))).join(before, ["stratum", "head"]).join(n, "stratum")
    return ranked.select("doc_no", "stratum", ((F.col("before") + F.col("r")) <= F.bround(F.col("n") * share)).alias("holdout"))


def quota_split(docs: DataFrame, weight: str, train: float, val: float, seed: int = 42) -> DataFrame:
    """doc_no, weight, split: in hash order a document goes to train while what precedes it is below the train quota of the total weight, then val, then test.

    The prefix sums run within leading hash bytes, whose offsets are sums of at most 256 numbers.
    """
    keyed = docs.select("doc_no", F.col(weight).cast("bigint").alias("weight")).withColumn("key", F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed))))).withColumn("head", F.substring("key", 1, 2))
    sizes = keyed.groupBy("head").agg(F.sum("weight").alias("w"))
    heads = sizes.withColumn("before", F.coalesce(F.sum("w").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("w")
    total = sizes.agg(F.sum("w").alias("total"))
    inner = F.coalesce(F.sum("weight").over(Window.partitionBy("head").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = keyed.withColumn("inner", inner).join(heads, "head").join(total)
    filled = F.col("before") + F.col("inner")
    split = F.when(filled < F.col("total") * train, "train").when(filled < F.col("total") * (train + val), "val").otherwise("test")
    return rows.select("doc_no", "weight", split.alias("split"))


def capped_per_group(docs: DataFrame, group: str, weight: str, cap: int, seed: int = 42) -> DataFrame:
    """doc_no, group, weight: in hash order the documents of each group whose predecessors weigh less than cap together."""
    keyed = docs.select("doc_no", F.coalesce(F.col(group).cast("string"), F.lit("ukjent")).alias("grp"), F.col(weight).cast("bigint").alias("weight"))
    keyed = keyed.withColumn("key", F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed))))).withColumn("head", F.substring("key", 1, 3))
    # sums within 4096 hash ranges and their offsets: no task sorts a group as a whole
    sizes = keyed.groupBy("grp", "head").agg(F.sum("weight").alias("w"))
    heads = sizes.withColumn("b", F.coalesce(F.sum("w").over(Window.partitionBy("grp").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("b") < cap).drop("w")
    inner = F.coalesce(F.sum("weight").over(Window.partitionBy("grp", "head").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.join(heads, ["grp", "head"]).withColumn("before", F.col("b") + inner).where(F.col("before") < cap).select("doc_no", "grp", "weight")


def random_documents(df: DataFrame, cond, n: int, seed: int = 42) -> DataFrame:
    """n documents, first by hash, among those with a row that meets the condition."""
    docs = df.where(cond).select("doc_no").distinct()
    return docs.orderBy(F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed)))), "doc_no").limit(n)
