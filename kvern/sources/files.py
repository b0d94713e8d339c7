"""Readers and writers of the files around the tables: tolerant CSV, JSON caches, lists, label files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions.geometry import Box, centre_format
from kvern.functions.keys import doc_number

RESULT_COLUMNS = ("navn", "side", "bilde_bredde", "bilde_hoyde", "x0", "y0", "x1", "y1", "kilde", "yolo_conf", "paddle_rec_score")


def text_csv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """A CSV with a header, every column text; a byte order mark before the first name is dropped, as are comment lines."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "inferSchema": False}
    df = spark.read.options(**options, **({"comment": comment} if comment else {})).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """The result table from CSV: numbers tried, blanks null, a pred_id from the content where the file has none; older files' `conf` counts as yolo_conf."""
    from kvern.operators.views import FEATURES

    raw = text_csv(spark, path)
    have = set(raw.columns)
    if "yolo_conf" not in have and "conf" in have:
        raw = raw.withColumnRenamed("conf", "yolo_conf")
        have = set(raw.columns)
    num = lambda c, t="double": (F.nullif(F.trim(c), F.lit("")).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c)
    key = F.col("pred_id").try_cast("bigint") if "pred_id" in have else F.xxhash64(*[F.col(c) for c in RESULT_COLUMNS if c in have])
    return raw.select(
        key.alias("pred_id"), "navn", *[num(c, "int") for c in ("side", "bilde_bredde", "bilde_hoyde")], *[num(c) for c in ("x0", "y0", "x1", "y1")],
        (F.col("kilde") if "kilde" in have else F.lit(None).cast("string")).alias("kilde"), num("yolo_conf"), num("paddle_rec_score"), *[num(f) for f in FEATURES],
    ).where("side is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: one per line; # starts a comment anywhere."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("id")).where("id <> ''").distinct()


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """doc_no: a file name or number per line; lines that start with # are comments."""
    return spark.read.text(path).where(~F.trim("value").startswith("#")).select(doc_number(F.col("value")).alias("doc_no")).where("doc_no is not null").distinct()


def added_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows noted as missing: label_id, doc_no, side, x0..y1 in points, rounded to two decimals."""
    from kvern.functions.keys import number, whole_number
    from kvern.operators.labels import added_rows

    raw = text_csv(spark, path, comment="#")
    x, y, w, h = (F.round(number(F.col(c)), 2) for c in ("x", "y", "width", "height"))
    b = Box(x, y, x + w, y + h).sorted()
    rows = raw.select(doc_number(F.col("fil_revisjon_id")).alias("doc_no"), whole_number(F.col("sidetall")).alias("side"), *[c.alias(n) for n, c in zip(Box._fields, b)])
    return added_rows(rows.where("doc_no is not null and side is not null and x1 > x0 and y1 > y0"))


OCR_SCHEMA = "version int, ocr_model string, dpi int, pages array<struct<page:int,rotation:int,tokens:array<struct<text:string,x0:double,y0:double,x1:double,y1:double,rec_score:double>>>>"
DETECTOR_SCHEMA = "version int, imgsz int, dpi int, conf_floor double, pages array<struct<page:int,rotation:int,boxes:array<array<double>>>>"


def _named(spark: SparkSession, path: str, schema: str, per_line: bool) -> DataFrame:
    """Cache documents, one a file named after the document, or one a line with the document's name in `name`."""
    rows = spark.read.schema(schema + ", name string").option("multiLine", not per_line).json(path)
    return rows.withColumn("doc", F.coalesce(doc_number(F.col("name")), doc_number(F.input_file_name())) if per_line else doc_number(F.input_file_name()))


def ocr_pages(spark: SparkSession, path: str, version: int = 2, model: str = "v6", dpi: int = 300, per_line: bool = False) -> DataFrame:
    """doc, page, rotation of the valid OCR caches."""
    valid = _named(spark, path, OCR_SCHEMA, per_line).where((F.col("version") == version) & (F.col("ocr_model") == model) & (F.col("dpi") == dpi))
    return valid.select("doc", F.explode("pages").alias("p")).select("doc", "p.page", "p.rotation")


def ocr_cache(spark: SparkSession, path: str, version: int = 2, model: str = "v6", dpi: int = 300, per_line: bool = False) -> DataFrame:
    """Tokens of the valid OCR caches: doc, page, rotation, ord, text, x0..y1, rec_score; a cache of another version, model or resolution is a miss."""
    valid = _named(spark, path, OCR_SCHEMA, per_line).where((F.col("version") == version) & (F.col("ocr_model") == model) & (F.col("dpi") == dpi))
    pages = valid.select("doc", F.explode("pages").alias("p"))
    return pages.select("doc", "p.page", "p.rotation", F.posexplode("p.tokens").alias("ord", "t")).select("doc", "page", "rotation", "ord", "t.*")


def detector_cache(spark: SparkSession, path: str, rotations: DataFrame, version: int = 1, imgsz: int = 1280, dpi: int = 300, conf: float = 0.01, per_line: bool = False) -> DataFrame:
    """Boxes of the valid detector caches at or above conf: doc, page, ord, x0..y1, conf.

    A cache is valid with the right header, a floor at or below conf, and exactly the pages and rotations of `rotations` (doc, page, rotation).
    """
    head = _named(spark, path, DETECTOR_SCHEMA, per_line).where((F.col("version") == version) & (F.col("imgsz") == imgsz) & (F.col("dpi") == dpi) & (F.col("conf_floor") <= conf))
    wanted = rotations.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("page", "rotation"))).alias("wanted"))
    own = F.array_sort(F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["rotation"].alias("rotation"))))
    valid = head.join(wanted, "doc").where(own == F.col("wanted"))
    boxes = valid.select("doc", F.explode("pages").alias("p")).select("doc", "p.page", F.posexplode("p.boxes").alias("ord", "b"))
    rows = boxes.select("doc", "page", "ord", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "conf"))])
    return rows.where(F.col("conf") >= conf)


def log_header(spark: SparkSession, path: str, prefixes: dict[str, str]) -> DataFrame:
    """name, value: the first line of each file that begins with one of the prefixes (name -> pattern)."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.nullif(F.regexp_extract("value", f"^(?:{p})\\s*(.*)$", 1), F.lit("")).alias("v")) for n, p in prefixes.items()])
    return lines.select("file", "block", "line", F.explode(found).alias("f")).where("f.v is not null").groupBy("file", "f.name").agg(F.min_by("f.v", F.struct("block", "line")).alias("value"))


def missing_caches(docs: DataFrame, ocr: DataFrame, detected: DataFrame) -> DataFrame:
    """doc of the documents without a valid OCR cache (doc of ocr_pages), or without a valid detector cache, which can't be judged without the first."""
    return docs.select("doc").distinct().join(ocr.select("doc").distinct().join(detected.select("doc").distinct(), "doc", "left_semi"), "doc", "left_anti")


def box_list(spark: SparkSession, path: str) -> DataFrame:
    """doc_no, side, x0..y1 of a list of boxes in pixels; rows that can't be read are left out."""
    raw = text_csv(spark, path)
    rows = raw.select(doc_number(F.col("fil")).alias("doc_no"), F.col("side").try_cast("int").alias("side"), *[F.col(c).try_cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return rows.dropna()


def sent_csv(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """doc_no, side, x0..y1 (points, sorted) of label-like rows whose page exists in pages (doc_no, side)."""
    from kvern.functions.keys import number, whole_number

    raw = text_csv(spark, path)
    x, y, w, h = (number(F.col(c)) for c in ("x", "y", "width", "height"))
    b = Box(x, y, x + w, y + h).sorted()
    rows = raw.select(doc_number(F.col("fil_revisjon_id")).alias("doc_no"), whole_number(F.col("sidetall")).alias("side"), *[c.alias(n) for n, c in zip(Box._fields, b)]).dropna()
    return rows.join(pages.select("doc_no", "side").distinct(), ["doc_no", "side"], "left_semi")


def selected_files(names: DataFrame, choice: list[str] | None = None, count: int | None = None, exact: bool = False) -> DataFrame:
    """fil of the chosen files: by exact stem, by part of the name, the first `count`, or all; names: fil."""
    base = F.substring_index("fil", "/", -1)
    wanted = [c.strip() for c in choice or [] if c.strip()]
    if wanted and exact:
        stems = [re.sub(r"(?<=.)\\.[^.]*$", "", c) for c in wanted]
        return names.where(F.regexp_replace(base, r"(?<=.)\\.[^.]*$", "").isin(stems)).select("fil").distinct()
    if wanted:
        hit = F.lit(False)
        for c in wanted:
            hit = hit | base.contains(c)
        return names.where(hit).select("fil").distinct()
    return names.select("fil").distinct().orderBy("fil").limit(count) if count else names.select("fil").distinct()


def page_boxes_of_results(preds: DataFrame) -> DataFrame:
    """navn, side, bilde_bredde, bilde_hoyde, boxes: a result table per page, boxes in order of position."""
    box = F.struct("y0", "x0", "x1", "y1", "kilde", "yolo_conf", "paddle_rec_score")
    return preds.groupBy("navn", "side").agg(F.min("bilde_bredde").alias("bilde_bredde"), F.min("bilde_hoyde").alias("bilde_hoyde"), F.array_sort(F.collect_list(box)).alias("boxes"))


def png_size(c: Column) -> Column:
    """struct(width, height) of a PNG's header; null for other bytes."""
    part = lambda at: F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A", F.struct(part(17).alias("width"), part(21).alias("height")))


def pdf_state(c: Column) -> Column:
    """pdf, protected or other of a fetched file's bytes."""
    head, text = F.substring(c, 1, 4), F.decode(c, "ISO-8859-1")
    return F.when(F.decode(head, "ISO-8859-1") != "%PDF", "other").when(text.contains("/Encrypt"), "protected").otherwise("pdf")


def word_tokens(results: DataFrame) -> DataFrame:
    """doc, page, ord, text, x0..y1, rec_score of OCR results (doc, page, lines: array of text, score, poly, words of text, score, box).

    Words count where a line has them, with the line's score where they have none; else the line itself, by the extent of
    its polygon.
    """
    lines = results.select("doc", "page", F.posexplode("lines").alias("i", "l"))
    extent = lambda f, k: f(F.transform("l.poly", lambda p: p[k]))
    line = F.array(F.struct(F.col("l.text").alias("text"), F.col("l.score").alias("score"), F.array(extent(F.array_min, 0), extent(F.array_min, 1), extent(F.array_max, 0), extent(F.array_max, 1)).alias("box")))
    words = F.transform("l.words", lambda w: F.struct(w["text"].alias("text"), F.coalesce(w["score"], F.col("l.score")).alias("score"), w["box"].alias("box")))
    items = lines.select("doc", "page", "i", F.posexplode(F.when(F.size("l.words") > 0, words).otherwise(line)).alias("j", "t")).where("trim(t.text) <> ''")
    order = (F.row_number().over(Window.partitionBy("doc", "page").orderBy("i", "j")) - 1).cast("int")
    return items.select("doc", "page", order.alias("ord"), "t.text", *[F.col("t.box")[k].cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("t.score").alias("rec_score"))


def sectioned_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, section, pos, key, value of '## Name' blocks of key,value lines; each file is one small report and is read by itself."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    order = Window.partitionBy("file").orderBy("pos")
    named = files.withColumn("section", F.last(F.when(F.col("line").startswith("## "), F.substring("line", 4, 1000)), ignorenulls=True).over(order))
    return named.where(~F.col("line").startswith("##") & (F.trim("line") != "")).select("file", "section", "pos", F.substring_index("line", ",", 1).alias("key"), F.expr("substring(line, locate(',', line) + 1)").alias("value"))


# ----- sinks

def write_result_csv(preds: DataFrame, path: str, mode: str = "append") -> None:
    """Box rows as CSV, sorted within files by name and page; null is blank."""
    preds.sortWithinPartitions("navn", "side").write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_label_files(labels: DataFrame, pages: DataFrame, path: str, buckets: int = 64) -> None:
    """The label lines of each page (doc_no, side, content), in a fixed number of folders by the hash of the document; pages: doc_no, side, pw, ph in points."""
    bucket = F.pmod(F.xxhash64("doc_no"), F.lit(buckets)).cast("int")
    label_lines(labels, pages).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def label_lines(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_no, side, content: the page's label lines in order of position; a page holds what fits on a sheet."""
    rows = labels.join(pages, ["doc_no", "side"]).select("doc_no", "side", "y0", "x0", centre_format(Box.of(), F.col("pw"), F.col("ph")).alias("line"))
    return rows.groupBy("doc_no", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line"))), lambda s: s["line"]), "\n").alias("content"))


def write_code_lists(meta: DataFrame, path: str) -> None:
    """Document numbers per document-type code, one folder each."""
    meta.select(F.explode("codes").alias("code"), F.col("doc_no").cast("string").alias("value")).distinct().write.mode("overwrite").partitionBy("code").text(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write where nothing is yet; an existing table stays."""
    df.write.mode("ignore").parquet(path)


def write_text_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any table as CSV with a header; null is blank, quotes are doubled."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_run(details: DataFrame, summary: dict[str, dict[str, object]], path: str, log: str = "") -> None:
    """A run folder: detaljer (CSV), sammendrag (sections of key,value lines, a handful of numbers), logg."""
    spark = details.sparkSession
    write_text_csv(details, f"{path}/detaljer")
    lines = [line for name, rows in summary.items() for line in (f"## {name}", *(f"{k},{v}" for k, v in rows.items()))]
    for name, content in (("sammendrag", "\n".join(lines)), ("logg", log)):
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def write_manifest(manifest: DataFrame, sampling: dict, path: str) -> None:
    """A manifest as CSV and, beside it, how it was drawn as JSON."""
    write_text_csv(manifest, f"{path}/manifest")
    manifest.sparkSession.createDataFrame([(json.dumps(sampling, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/utvalg")


def write_judgements(rows: DataFrame, path: str, contentless: list[str]) -> None:
    """full_info (all columns), uten_innhold (only the given columns), gjennomgang (the column linje as text)."""
    write_text_csv(rows.drop("linje"), f"{path}/full_info")
    write_text_csv(rows.select(*contentless), f"{path}/uten_innhold")
    rows.select("linje").write.mode("overwrite").text(f"{path}/gjennomgang")


def write_answers(answers: DataFrame, path: str, mode: str = "append") -> None:
    """Raw answers, one JSON object a line."""
    answers.write.mode(mode).json(path)


def answer_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, version, raw of a cache of answers."""
    return spark.read.schema("key string, version int, raw string").json(path)
