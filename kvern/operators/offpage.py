"""Labels beside their page: page boxes, where labels lie in two coordinate spaces, and numbers they leave uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.functions.geometry import PX_PER_PT, Box, area, intersection_area, placement

# Part of the redacted digits that one label must cover, and the slack in points when a label is matched to a line.
COVER, SLACK = 0.5, 4.0


def cropbox_differs(tolerance: float = 1.0) -> Column:
    """Whether the crop box (cw, ch, at cx, cy) differs from the media box (mw, mh) by more than the tolerance in points."""
    off = lambda c: F.abs(c) > tolerance
    return off(F.col("cw") - F.col("mw")) | off(F.col("ch") - F.col("mh")) | off(F.col("cx")) | off(F.col("cy"))


def page_census(boxes: DataFrame) -> DataFrame:
    """what, n, share over page boxes (doc_no, side, rotate, mw, mh, cx, cy, cw, ch): pages per rotation, pages and documents with a crop box, documents with turned pages."""
    marked = boxes.select("doc_no", "rotate", cropbox_differs().alias("crop"))
    per_page = marked.groupBy("rotate").agg(F.count(F.lit(1)).alias("n"), F.count_if("crop").alias("crop"))
    docs = marked.groupBy("doc_no").agg(F.max(F.col("rotate").isin(90, 270)).alias("turned"), F.max("crop").alias("crop"), F.count(F.lit(1)).alias("pages"))
    d = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if("turned").alias("turned"), F.count_if("crop").alias("crop"), F.sum("pages").alias("pages"))
    row = lambda what, n, of: F.struct(F.lit(what).alias("what"), n.alias("n"), F.round(n / of, 6).alias("share"))
    whole = d.select(F.explode(F.array(row("documents turned", F.col("turned"), F.col("docs")), row("documents with crop box", F.col("crop"), F.col("docs")))).alias("r")).select("r.*")
    crops = per_page.agg(F.sum("crop").alias("n")).join(d.select("pages")).select(F.lit("pages with crop box").alias("what"), "n", F.round(F.col("n") / F.col("pages"), 6).alias("share"))
    turns = per_page.join(d.select("pages")).select(F.concat(F.lit("rotate "), F.col("rotate")).alias("what"), "n", F.round(F.col("n") / F.col("pages"), 6).alias("share"))
    return turns.union(crops).union(whole)


def who() -> Column:
    return F.when(F.col("ml"), F.when(F.col("status") == "", "ML unprocessed").otherwise("ML")).otherwise("manual")


def burned() -> Column:
    """Labels whose box was redacted: drawn by hand, or the model's and accepted or moved."""
    return ~F.col("ml") | F.col("status").isin("ACCEPTED", "MOVED")


def flipped(b: Box, height: Column, origin: str) -> Box:
    """The box with its origin at the top of a page of the given height."""
    return b if origin == "top" else Box(b.x0, height - b.y1, b.x1, height - b.y0)


def placement_census(labels: DataFrame, boxes: DataFrame, origin: str = "top") -> DataFrame:
    """page, who, stage, model, n: labels against the media box (stage) and against the page as it is seen (model; vw, vh); a label without its page is 'no such page'.

    With the origin at the bottom each space turns the label by its own height.
    """
    rows = labels.join(boxes, ["doc_no", "side"], "left")
    at = lambda w, h: placement(flipped(Box.of(), F.col(h), origin), F.col(w), F.col(h))
    page = F.when(F.col("mw").isNull(), "none").otherwise(F.concat(F.lit("rotate "), F.col("rotate"), F.when(cropbox_differs(), " + cropbox").otherwise("")))
    known = F.col("mw").isNotNull()
    return rows.groupBy(page.alias("page"), who().alias("who"), F.when(known, at("mw", "mh")).otherwise("no such page").alias("stage"), F.when(known, at("vw", "vh")).otherwise("").alias("model")).agg(F.count(F.lit(1)).alias("n"))


def covered_candidates(candidates: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_no, side, x0..y1 (points), n_digits, mod11, cover: number-shaped runs (layout.candidate_boxes, pixels) with the largest part of their last five digits that one burned label on the page covers."""
    to_pt = [(F.col(p + c) / PX_PER_PT).alias(p + c) for p in ("", "r") for c in Box._fields]
    c = candidates.select(F.col("doc").alias("doc_no"), F.col("page").alias("side"), *to_pt, "n_digits", "mod11").withColumn("no", F.monotonically_increasing_id())
    on = labels.where(burned()).join(pages, ["doc_no", "side"]).where("x1 > 0 and y1 > 0 and x0 < pw and y0 < ph").alias("l")
    r = Box.of("c.r")
    share = F.when(area(r) > 0, intersection_area(r, Box.of("l.")) / area(r)).otherwise(F.lit(0.0))
    keys = ["doc_no", "side", "no", "x0", "y0", "x1", "y1", "n_digits", "mod11"]
    same = (F.col("c.doc_no") == F.col("l.doc_no")) & (F.col("c.side") == F.col("l.side"))
    return c.alias("c").join(on, same, "left").groupBy(*[F.col(f"c.{k}") for k in keys]).agg(F.coalesce(F.max(share), F.lit(0.0)).alias("cover")).drop("no")


def off_page_verdicts(labels: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """label_id, kind (partial or outside), n_line, n_uncovered, verdict: labels not inside their page, with the candidates (of covered_candidates) on their line."""
    kind = placement(Box.of(), F.col("pw"), F.col("ph"))
    off = labels.join(pages, ["doc_no", "side"]).withColumn("kind", kind).where("kind <> 'inside'").alias("l")
    c = candidates.alias("c")
    near = (F.col("l.doc_no") == F.col("c.doc_no")) & (F.col("l.side") == F.col("c.side")) & (F.col("l.y0") - SLACK < F.col("c.y1")) & (F.col("c.y0") - SLACK < F.col("l.y1"))
    rows = off.join(c, near, "left").groupBy("l.label_id", "l.kind").agg(F.count("c.cover").alias("n_line"), F.count_if(F.col("c.cover") < COVER).alias("n_uncovered"))
    said = F.when(F.col("n_uncovered") > 0, "UNCOVERED fnr on this line").when(F.col("n_line") > 0, "line candidates all covered").otherwise("no candidate on this line")
    return rows.withColumn("verdict", said)
