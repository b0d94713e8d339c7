"""Answers of the box judge: content keys, the versioned cache, counters, guard, baselines, review rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.functions import numbers, text

# Version of a cached answer, hex digits of a fingerprint and of an item key, short names of what can't be read.
VERSION, FINGERPRINT, ITEM = 1, 16, 24
SHORT = {text.KEYWORD: "answer was not JSON", text.UNPARSABLE: "answer unreadable", text.EMPTY: "answer empty", text.OMITTED: "no «svar» field"}


def fingerprint(**settings) -> str:
    """The version of a prompt, model and its settings: equal settings have an equal fingerprint in any order."""
    return hashlib.sha256(json.dumps(settings, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:FINGERPRINT]


def item_key(image: Column, ocr: Column) -> Column:
    """The content key of what the judge is shown: image text and OCR text as a JSON string; null without either."""
    shown = F.concat(F.coalesce(image, F.lit("")), F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(F.lit('"'), F.replace(F.replace(F.replace(ocr, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise(""))
    return F.when(shown != "", F.substring(F.sha2(shown, 256), 1, ITEM))


def usable(cache: DataFrame) -> DataFrame:
    """key, raw of the cache rows (key, version, raw) of this version with an answer, one per key."""
    kept = cache.where((F.col("version") == VERSION) & (F.trim("raw") != "") & F.col("key").isNotNull())
    return kept.groupBy("key").agg(F.min("raw").alias("raw"))


def looked_up(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (with key) and svar, note: hit where the cache has a readable answer, else why not; what isn't read is ja."""
    found = text.with_answer(items.join(usable(cache), "key", "left"), "raw", "a")
    short = F.coalesce(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[F.col("a.feil")], F.lit("unparsed"))
    note = F.when(F.col("raw").isNull(), "miss").when(F.col("a.feil") == "", "hit").otherwise(short)
    return found.select(*items.columns, F.when(note == "hit", F.col("a.svar")).otherwise("ja").alias("svar"), note.alias("note"))


def to_store(answers: DataFrame) -> DataFrame:
    """key, version, raw of new answers (key, raw) that may be cached: readable ones, one per key."""
    read = text.with_answer(answers.where("key is not null"), "raw", "a").where("a.feil = ''")
    return read.groupBy("key").agg(F.min("raw").alias("raw")).select("key", F.lit(VERSION).alias("version"), "raw")


def counters(judged: DataFrame) -> DataFrame:
    """kilde (SUM for all), judged, dropped, hits, not_cached (map of note to n): the verdicts' counts; notes hit, written and off say nothing."""
    rows = judged.groupBy("kilde", "note").agg(F.count(F.lit(1)).alias("n"), F.count_if("dropped").alias("d"))
    both = rows.union(rows.select(F.lit("SUM"), "note", "n", "d"))
    per = both.groupBy("kilde", "note").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    said = F.when(~F.col("note").isin("hit", "written", "off"), F.struct("note", "n"))
    return per.groupBy("kilde").agg(
        F.sum("n").alias("judged"), F.sum("d").alias("dropped"), F.coalesce(F.sum(F.when(F.col("note") == "hit", F.col("n"))), F.lit(0)).alias("hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: F.concat(s["note"], F.lit("="), s["n"])), ";").alias("not_cached"),
    )


def failed_documents(judged: DataFrame) -> DataFrame:
    """doc_no, failed, judged of documents with boxes the judge answered nothing for."""
    failed = F.count_if(F.col("note").isin("call failed", "breaker open"))
    return judged.groupBy("doc_no").agg(failed.alias("failed"), F.count(F.lit(1)).alias("judged")).where("failed > 0")


def undecided(manifest: DataFrame) -> DataFrame:
    """Manifest rows whose outcome the number guard doesn't decide already from the line or the block."""
    return manifest.where(~numbers.protects(F.col("ocr_linje"), F.col("ocr_blokk")))


def baselines(manifest: DataFrame) -> DataFrame:
    """nr and the answers of the three rules a judge must beat: no candidate on the line, a decimal in the number, both."""
    none = ~numbers.has_candidate(F.coalesce("ocr_linje", F.lit("")))
    decimal = numbers.has_decimal(F.coalesce("ocr_tekst", F.lit("")))
    said = lambda drop, name: F.when(drop, "nei").otherwise("ja").alias(name)
    return manifest.select("nr", said(none, "fnr_kandidat"), said(decimal, "desimal"), said(none & decimal, "begge"))


def short_error(c: Column, most: int = 200) -> Column:
    """An error on one line: what follows the last summary heading, without outer blanks, dashes and colons."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.substring(F.regexp_replace(F.substring_index(line, "Error Message Summary", -1), "^[ :-]+|[ :-]+$", ""), 1, most)


def is_memory_error(c: Column) -> Column:
    return c.rlike("Out of memory|ResourceExhausted|OutOfMemory|CUDA out of memory")


def review_rows(judged: DataFrame) -> DataFrame:
    """nr, riktig, klasse, svar, linje: the rows of the review table; right, needless (ja on BOM) or lost (nei on a covering box)."""
    right = F.col("svar") == F.when(F.col("gruppe") == "BOM", "nei").otherwise("ja")
    mark = F.when(right, "✅").when(F.col("gruppe") == "BOM", "🟡").otherwise("❌")
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("nr").cast("string"), mark, cell(F.col("klasse")), cell(F.col("svar")), cell(F.col("begrunnelse"))), F.lit(" |"))
    return judged.select("nr", mark.alias("riktig"), "klasse", "svar", row.alias("linje"))
