"""Problem 5: the score cutoff that keeps a target fraction of each source.

Range-sort the distinct scores with their counts by source and score, count per
range partition and source, prefix-sum those counts on the driver (partitions x
targets values) to find the partition that holds the target row, then read the
exact row inside that one partition.

Defined results: a record without id, source or a score in 0..1 is not scored;
a record that is repeated counts once, with its highest score where repeats
differ; equal scores are kept or dropped together; a target above 1, or a source
without scored records, has no cutoff and keeps nothing; a target of 0 or less
keeps the records of the highest score; a null target row is left out.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.keys import tag
from kvern.session import materialize


def target_rows(kuttmaal: DataFrame) -> DataFrame:
    """The distinct usable target rows: kilde, poengfelt, maal_andel."""
    return (
        kuttmaal.select(tag(F.col("kilde")).alias("kilde"), F.trim("poengfelt").alias("poengfelt"), F.col("maal_andel").cast("double").alias("maal_andel"))
        .where("kilde is not null and poengfelt is not null and maal_andel is not null and not isnan(maal_andel)")
        .distinct()
    )


def scored_records(resultat: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per pred_id, source and score field that a target names: pred_id, kilde, poengfelt, score."""
    fields = [r[0] for r in targets.select("poengfelt").distinct().collect() if r[0] in resultat.columns]
    schema = "pred_id bigint, kilde string, poengfelt string, score double"
    if not fields:
        return resultat.sparkSession.createDataFrame([], schema)
    long = resultat.select(
        F.col("pred_id").cast("bigint").alias("pred_id"),
        tag(F.col("kilde")).alias("kilde"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("poengfelt"), F.col(f).cast("double").alias("score")) for f in fields])).alias("s"),
    ).select("pred_id", "kilde", "s.poengfelt", "s.score")
    usable = long.where("pred_id is not null and score >= 0 and score <= 1")
    named = targets.select("kilde", "poengfelt").distinct()
    return usable.join(named, ["kilde", "poengfelt"], "left_semi").groupBy("pred_id", "kilde", "poengfelt").agg(F.max("score").alias("score"))


def cutoffs(resultat: DataFrame, kuttmaal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cutoffs, scored records). Cutoffs: kilde, poengfelt, maal_andel, cutoff, n_scored, n_kept, one row per target."""
    spark = resultat.sparkSession
    targets = target_rows(kuttmaal)
    # read for the counts and again for the kept records
    scored = materialize(scored_records(resultat, targets))
    # equal scores collapse before the sort, so one hot score is one row
    counts = scored.groupBy("kilde", "poengfelt", "score").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(
        counts.repartitionByRange("kilde", "poengfelt", F.desc("score")).withColumn("part", F.spark_partition_id())
    )
    per_part = ranged.groupBy("kilde", "poengfelt", "part").agg(F.sum("n").alias("n")).collect()

    found = []
    for t in targets.collect():
        parts = sorted((r["part"], r["n"]) for r in per_part if (r["kilde"], r["poengfelt"]) == (t["kilde"], t["poengfelt"]))
        total = sum(n for _, n in parts)
        wanted = max(1, math.ceil(Decimal(repr(t["maal_andel"])) * total)) if math.isfinite(t["maal_andel"]) else total + 1
        before, at = 0, None
        for part, n in parts:
            if before + n >= wanted:
                at = part
                break
            before += n
        found.append((t["kilde"], t["poengfelt"], t["maal_andel"], at, wanted, before, total))
    places = spark.createDataFrame(found, "kilde string, poengfelt string, maal_andel double, part int, wanted bigint, above bigint, n_scored bigint")

    running = Window.partitionBy("kilde", "poengfelt", "maal_andel").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    exact = (
        places.join(ranged, ["kilde", "poengfelt", "part"])
        .withColumn("reached", F.col("above") + F.sum("n").over(running))
        .where("reached >= wanted")
        .groupBy("kilde", "poengfelt", "maal_andel")
        .agg(F.max("score").alias("cutoff"), F.min("reached").alias("n_kept"))
    )
    cut = places.drop("part", "wanted", "above").join(exact, ["kilde", "poengfelt", "maal_andel"], "left").select(
        "kilde", "poengfelt", "maal_andel", "cutoff", "n_scored", F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept")
    )
    return cut, scored


def kept_records(resultat: DataFrame, kuttmaal: DataFrame) -> DataFrame:
    """pred_id of each scored record at or above a cutoff, once."""
    cut, scored = cutoffs(resultat, kuttmaal)
    least = cut.where("cutoff is not null").groupBy("kilde", "poengfelt").agg(F.min("cutoff").alias("cutoff"))
    return scored.join(least, ["kilde", "poengfelt"]).where("score >= cutoff").select("pred_id").distinct()
