"""What must hold for the results of problems 1, 2, 6 and 7, counted over the whole results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.llm import leaks, mixing, pii, splits
from kvern.session import materialize

_MARK = re.compile("|".join(re.escape(p) for p in pii.PLACEHOLDER.values()))


def masked_texts(manifest: DataFrame, verdicts: DataFrame, names: DataFrame) -> DataFrame:
    """felt, n, n_null, n_broken, n_numbers_left: texts that don't come out as their own parts around the placeholders, and valid identity numbers still in them."""
    stored = pii.fields(manifest, verdicts).distinct()
    out = materialize(pii.masked(manifest, verdicts, names).withColumnRenamed("tekst", "ny"))
    texts = stored.withColumn("key", F.xxhash64("felt", "rad_id"))
    both = out.withColumn("key", F.xxhash64("felt", "rad_id"))
    left = texts.groupBy("key", "felt").agg(F.collect_set("tekst").alias("old"), F.count(F.lit(1)).alias("n_old"))
    right = both.groupBy("key").agg(F.collect_list("ny").alias("new"), F.count(F.lit(1)).alias("n_new"), F.count_if(F.col("ny").isNull()).alias("n_null"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for felt, old, new, n_old, n_new, n_null in zip(f.felt, f.old, f.new, f.n_old, f.n_new, f.n_null):
                patterns = [[re.escape(p) for p in _MARK.split(x)] for x in new]
                fits = [any(re.fullmatch("(?s:.+)".join(p), x) or x == y for x in old) for p, y in zip(patterns, new)]
                rows.append((felt, int(n_new), int(n_null), len(fits) - sum(fits) + int(n_old != n_new), sum(len(pii.identity_numbers(pii.view(x)[0])) for x in new)))
            yield pd.DataFrame(rows, columns=["felt", "n", "n_null", "n_broken", "n_numbers_left"])

    per = left.join(right, "key", "left").na.fill(0, ["n_new", "n_null"]).withColumn("new", F.coalesce("new", F.array().cast("array<string>"))).drop("key")
    counted = per.mapInPandas(run, "felt string, n int, n_null int, n_broken int, n_numbers_left int")
    return counted.groupBy("felt").agg(*[F.sum(c).alias(c) for c in ("n", "n_null", "n_broken", "n_numbers_left")])


def split_rows(labels: DataFrame, metadata: DataFrame, within: float = 0.02) -> DataFrame:
    """n_rows, n_split_groups (groups in several splits), n_splits, near: whether each split has its part of the rows of every label, or differs by less than the largest group, within a part of all."""
    out = materialize(splits.grouped_splits(labels, metadata))
    torn = out.groupBy("gruppe").agg(F.count_distinct("splitt").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n_split_groups"))
    per = out.groupBy("splitt").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_splits"))
    wanted = labels.sparkSession.createDataFrame(list(splits.PROPORTIONS.items()), "splitt string, p double")
    near = per.join(wanted, "splitt").crossJoin(total).agg(F.bool_and(F.abs(F.col("n") / F.col("n_rows") - F.col("p")) <= within).alias("near"))
    return total.join(torn).join(near).select("n_rows", "n_split_groups", "n_splits", "near")


def cleaned_texts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """n_documents, n_rows, n_left (cleaned texts in which a passage is still found), n_broken (lengths that don't add up)."""
    out = materialize(leaks.without_leaks(documents, items))
    left = leaks.leaked_items(out.where("text is not null").select("doc_id", "text"), items).select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_left"))
    length = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    sums = out.join(length, "doc_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").isNotNull() & (F.length("text") + F.col("cut_chars") != F.col("n"))).alias("n_broken"))
    return sums.join(left).select("n_documents", "n_rows", "n_left", "n_broken")


def mixed_sources(documents: DataFrame, targets: DataFrame, within: float = 0.02) -> DataFrame:
    """source, near (the share reached is the scaled target), capped (no text beyond its cap) of each source that is used."""
    rows = materialize(mixing.mixed_shares(documents, targets)).where("budget > 0")
    whole = rows.agg(F.sum("maal_andel").alias("whole"))
    return rows.join(whole).select("source", (F.abs(F.col("share") - F.col("maal_andel") / F.col("whole")) <= within).alias("near"), (F.col("most_copies") <= F.col("maks_gjentak")).alias("capped"))
