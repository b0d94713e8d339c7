"""Label policy: excluded statuses, retracted ids, added rows; reclassification of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.functions.geometry import PX_PER_PT, Box, same_box


def added_id(doc, page, box: Box):
    """'mangler-' and twelve hex digits of the key and the box in two decimals."""
    two = lambda c: F.format_string("%.2f", c)
    return F.concat(F.lit("mangler-"), F.substring(F.sha2(F.concat_ws("|", doc.cast("string"), page.cast("string"), two(box.x0), two(box.y0), two(box.width), two(box.height)), 256), 1, 12))


def added_rows(boxes: DataFrame) -> DataFrame:
    """label_id, doc_no, side, x0..y1 for boxes (doc_no, side, x0..y1 in points) that were noted as missing."""
    b = Box.of()
    return boxes.select(added_id(F.col("doc_no"), F.col("side"), b).alias("label_id"), "doc_no", "side", "x0", "y0", "x1", "y1").distinct()


def policy(labels: DataFrame, retracted: DataFrame, added: DataFrame, excluded=("REJECTED",)) -> DataFrame:
    """Every label and added row with its outcome: kept, excluded status, retracted, or present (an added row whose box the file has).

    Columns: label_id, doc_no, side, x0..y1, origin (file or added), outcome. An added row can be retracted too.
    """
    cols = ["label_id", "doc_no", "side", "x0", "y0", "x1", "y1"]
    gone = retracted.select(F.col("label_id").alias("gone")).where("gone is not null").distinct()
    state = F.when(F.col("status").isin(*excluded), F.concat(F.lit("excluded "), F.col("status"))) if excluded else F.when(F.lit(False), "")
    file = labels.join(gone, F.col("label_id") == F.col("gone"), "left").select(*cols, F.lit("file").alias("origin"), F.coalesce(state, F.when(F.col("gone").isNotNull(), "retracted"), F.lit("kept")).alias("outcome"))
    kept = file.where("outcome = 'kept'").select("doc_no", "side", "x0", "y0", "x1", "y1").alias("f")
    new = added.select(*cols).alias("a")
    on = (F.col("a.doc_no") == F.col("f.doc_no")) & (F.col("a.side") == F.col("f.side")) & same_box(Box.of("a."), Box.of("f."))
    present = new.join(kept, on, "left_semi").select(F.col("label_id").alias("there")).distinct()
    extra = added.select(*cols).join(gone, F.col("label_id") == F.col("gone"), "left").join(present, F.col("label_id") == F.col("there"), "left")
    outcome = F.when(F.col("gone").isNotNull(), "retracted").when(F.col("there").isNotNull(), "present").otherwise("kept")
    return file.unionByName(extra.select(*cols, F.lit("added").alias("origin"), outcome.alias("outcome")))


def policy_tally(decided: DataFrame) -> DataFrame:
    return decided.groupBy("origin", "outcome").agg(F.count(F.lit(1)).alias("n"))


def reclassified(manifest: DataFrame, retracted: DataFrame, added: DataFrame) -> DataFrame:
    """nr, before, after, label_id: covering rows whose labels are all retracted become BOM, then BOM rows over an added box become TREFF with its ids.

    manifest: rows of manifest_rows; ids are joined by ';'. Added rows that are retracted don't count.
    """
    ids = F.filter(F.transform(F.split(F.coalesce("label_id", F.lit("")), ";"), lambda i: F.trim(i)), lambda i: i != "")
    gone = retracted.select(F.col("label_id").alias("id")).where("id is not null").distinct()
    parts = manifest.where("klasse <> 'BOM'").select("nr", F.explode(ids).alias("id"))
    void = parts.join(gone.withColumn("g", F.lit(1)), "id", "left").groupBy("nr").agg(F.bool_and(F.col("g").isNotNull()).alias("void")).where("void")
    first = manifest.join(void, "nr", "left").withColumn("k1", F.when(F.col("void"), "BOM").otherwise(F.col("klasse")))
    live = added.join(gone, added["label_id"] == gone["id"], "left_anti")
    px = [(F.col(c) * PX_PER_PT).alias(c) for c in ("x0", "y0", "x1", "y1")]
    boxes = live.select("doc_no", "side", F.col("label_id").alias("added_id"), *px).alias("a")
    over = first.where("k1 = 'BOM'").select("nr", "doc_no", "side", "x0", "y0", "x1", "y1").alias("m")
    on = (F.col("m.doc_no") == F.col("a.doc_no")) & (F.col("m.side") == F.col("a.side")) & same_box(Box.of("m."), Box.of("a."))
    found = over.join(boxes, on).groupBy("nr").agg(F.array_join(F.array_sort(F.collect_set("added_id")), ";").alias("found"))
    after = F.when(F.col("found").isNotNull(), "TREFF").otherwise(F.col("k1"))
    return first.join(found, "nr", "left").select("nr", F.col("klasse").alias("before"), after.alias("after"), F.coalesce("found", "label_id").alias("label_id")).where("before <> after")
