"""Tolerant views of the stored tables: predictions, truth boxes, documents' metadata, verdicts.

Rows that can't be read are left out; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.geometry import PX_PER_PT, Box, area
from kvern.functions.keys import doc_number, number, tag, upper_tag, whole_number

# The text features of a prediction, and the page size taken where none is known (A4 in points).
FEATURES = (
    "har_tokens", "n_siffer", "n_bokstaver", "rec_min", "rec_median", "rec_min_linje", "n_siffer_linje", "siffer_run",
    "har_fnr_kandidat", "har_desimal_naer", "har_00_run", "har_orgnr", "har_org_ord", "lang_run", "maks_luke", "har_desimal_luke",
)
A4 = (595.0, 842.0)


def known(c):
    """null for NaN."""
    return F.when(~F.isnan(c), c)


def prediction_pages(resultat: DataFrame) -> DataFrame:
    """pred_id, doc_no, side, bilde_bredde, bilde_hoyde of every usable row, repeats included: enough to know documents and page sizes without removing repeats."""
    read = resultat.select("pred_id", doc_number(F.col("navn")).alias("doc_no"), "side", "bilde_bredde", "bilde_hoyde", "x0", "y0", "x1", "y1")
    return read.where("pred_id is not null and doc_no is not null and side is not null and abs(x1 - x0) > 0 and abs(y1 - y0) > 0 and bilde_bredde > 0 and bilde_hoyde > 0").drop("x0", "y0", "x1", "y1")


def page_sizes(resultat: DataFrame) -> DataFrame:
    """doc_no, side, pw, ph (points) of every page with predictions, from its smallest pred_id: one aggregate, as repeats don't change it."""
    p = prediction_pages(resultat).groupBy("doc_no", "side").agg(F.min_by(F.struct("bilde_bredde", "bilde_hoyde"), "pred_id").alias("s"))
    return p.select("doc_no", "side", (F.col("s.bilde_bredde") / PX_PER_PT).alias("pw"), (F.col("s.bilde_hoyde") / PX_PER_PT).alias("ph"))


def predictions(resultat: DataFrame) -> DataFrame:
    """One row per pred_id: keys, pixels, n* (relative to the page), sizes in points, kilde, conf, rec, the features.

    Boxes without width or height, and pages without size, are left out; a missing source is 'unknown'.
    """
    px = Box.of()
    w, h = F.abs(px.width) / PX_PER_PT, F.abs(px.height) / PX_PER_PT
    base = resultat.dropDuplicates(["pred_id"]).where("pred_id is not null")
    usable = base.withColumn("doc_no", doc_number(F.col("navn"))).withColumn("w", w).withColumn("h", h).where("doc_no is not null and side is not null and w > 0 and h > 0 and bilde_bredde > 0 and bilde_hoyde > 0")
    norm = px.scaled(F.col("bilde_bredde"), F.col("bilde_hoyde"))
    return usable.select(
        "pred_id", "navn", "doc_no", "side", "bilde_bredde", "bilde_hoyde", "x0", "y0", "x1", "y1", "w", "h",
        *[c.alias("n" + n) for n, c in zip(Box._fields, norm)],
        area(norm).alias("norm_area"),
        (F.col("w") / F.col("h")).alias("ratio"),
        F.greatest(F.col("w") / F.col("h"), F.lit(1.0) / (F.col("w") / F.col("h"))).alias("elongation"),
        F.least("w", "h").alias("short_side"), F.greatest("w", "h").alias("long_side"),
        (F.col("w") * F.col("h")).alias("area"), (F.abs(px.width) * F.abs(px.height)).alias("areal_px"),
        F.coalesce(tag(F.col("kilde")), F.lit("unknown")).alias("kilde"),
        known(F.col("yolo_conf")).alias("conf"), known(F.col("paddle_rec_score")).alias("rec"),
        *[known(F.col(f)).alias(f) for f in FEATURES],
    )


def latest_labels(labels: DataFrame) -> DataFrame:
    """The row of each id with the highest version (null counts as 1), then the latest load: an aggregate with map-side combine, not a sort of all rows."""
    rest = [c for c in labels.columns if c != "id"]
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce("versjon", F.lit(1)), F.col("lastet")))
    return labels.where("id is not null").groupBy("id").agg(newest.alias("r")).select("id", "r.*")


def label_rows(labels: DataFrame) -> DataFrame:
    """Every latest label with a readable key and box: label_id, doc_no, side, x0..y1 in points, type, status, ml, versjon."""
    read = latest_labels(labels).select(
        F.col("id").alias("label_id"), doc_number(F.col("fil_revisjon_id")).alias("doc_no"), whole_number(F.col("sidetall")).alias("side"),
        *[number(F.col(c)).alias(c) for c in ("x", "y", "width", "height")],
        F.coalesce(upper_tag(F.col("type")), F.lit("(empty)")).alias("type"), F.coalesce(upper_tag(F.col("ml_status")), F.lit("")).alias("status"),
        (F.lower(F.trim("ml_generated")) == "true").alias("ml"), F.coalesce("versjon", F.lit(1)).alias("versjon"),
    )
    box = Box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")).sorted()
    placed = read.select("label_id", "doc_no", "side", *[c.alias(n) for n, c in zip(Box._fields, box)], "type", "status", F.coalesce("ml", F.lit(False)).alias("ml"), "versjon")
    return placed.where("doc_no is not null and side is not null and x1 > x0 and y1 > y0")


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """One row per document, the latest: doc_no, codes, electronic, year, decade."""
    newest = Window.partitionBy("doc_no").orderBy(F.col("lastet").desc_nulls_last(), F.col("fil_revisjon_id"), F.col("rettsstiftelsestyper"))
    rows = metadata.withColumn("doc_no", doc_number(F.col("fil_revisjon_id"))).where("doc_no is not null").withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    codes = F.filter(F.transform(F.split(F.coalesce("rettsstiftelsestyper", F.lit("")), ","), lambda c: F.upper(F.trim(F.substring_index(c, " - ", 1)))), lambda c: c != "")
    return rows.select(
        "doc_no", F.array_sort(F.array_distinct(codes)).alias("codes"),
        F.coalesce(F.lower(F.trim("er_elektronisk_tinglyst")).isin("true", "t", "1"), F.lit(False)).alias("electronic"),
        F.col("dokument_aar").alias("year"), (F.floor(F.col("dokument_aar") / 10) * 10).cast("int").alias("decade"),
        F.coalesce(F.lower(F.trim("ml_behandlet")).isin("true", "t", "1"), F.lit(False)).alias("processed"),
    )


def judged(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Manifest rows with their verdict, one row per nr: the first attempt without an error, else the first attempt.

    An answer other than nei is ja; unjudged rows are left out.
    """
    first = Window.partitionBy("nr").orderBy(F.when(F.coalesce("feil", F.lit("")) == "", 0).otherwise(1), "kjort", "verdict_id")
    best = verdicts.where("nr is not null").withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    answer = best.select("nr", F.when(F.lower(F.trim("svar")) == "nei", "nei").otherwise("ja").alias("svar"), F.coalesce("feil", F.lit("")).alias("feil"), "tall", "begrunnelse", "linjen", "sekunder")
    rows = manifest_rows(manifest)
    return rows.join(answer, "nr")


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """One row per nr with klasse and kilde trimmed; gruppe is BOM or DEKKENDE."""
    rows = manifest.dropDuplicates(["nr"]).where("nr is not null")
    klasse = F.coalesce(upper_tag(F.col("klasse")), F.lit("(EMPTY)"))
    doc = F.coalesce("doc_no", doc_number(F.col("fil")))
    return rows.select(
        "nr", doc.alias("doc_no"), "side", klasse.alias("klasse"), F.when(klasse == "BOM", "BOM").otherwise("DEKKENDE").alias("gruppe"),
        F.coalesce(tag(F.col("kilde")), F.lit("unknown")).alias("kilde"), "label_id", "dekkere", "x0", "y0", "x1", "y1", known(F.col("conf")).alias("conf"), "ocr_tekst", "ocr_linje", "ocr_blokk",
    )
