"""Numbers in text as Columns: identity and organisation numbers, digit runs, decimals, captions.

Digits are the ASCII digits throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of check digits, letters read for digits, characters allowed between digits.
FIRST_WEIGHTS = (3, 7, 6, 1, 8, 9, 4, 5, 2)
SECOND_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
ORG_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)
MISREAD, READ = "oOsSlIbB", "00551166"
GAP = " .-,_"

# Words of companies, and captions of an identity number.
ORG_WORDS = r"\b(AS|ASA|ANS|KS|NUF|IKS|BBL|BRL)\b|(?i:borettslag|boligbyggelag|sameie|stiftelse|forening|kommune|sparebank|bank|forsikring|org\.?\s*nr|organisasjonsn|foretak)"
CAPTION = r"(?i)(f\s*[øo]dsels\s*n|pers\s*[.\s]*n|p\s*\.\s*nr|f\s*\.\s*nr|fnr|personnummer)"
FIVE_RUN = r"(^|[^0-9])[0-9]{5}([^0-9]|$)"
ELEVEN = r"[0-9oOsSlIbB](?:[ .,_-]{0,2}[0-9oOsSlIbB]){10}"


def as_digits(c: Column) -> Column:
    return F.translate(c, MISREAD, READ)


def _digit(c: Column, at: int) -> Column:
    return F.substring(c, at + 1, 1).try_cast("int")


def _weighted(c: Column, weights) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(c, i) * w
    return total


def check_digit(c: Column, weights) -> Column:
    """(11 - sum mod 11) mod 11; 10 equals no digit."""
    return F.pmod(F.lit(11) - F.pmod(_weighted(c, weights), F.lit(11)), F.lit(11))


def identity_form(c: Column) -> Column:
    """Eleven digits that begin with a day (1-31, or 41-71) and a month."""
    day, month = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 3, 2).try_cast("int")
    return F.coalesce(c.rlike("^[0-9]{11}$") & (day.between(1, 31) | day.between(41, 71)) & month.between(1, 12), F.lit(False))


def valid_mod11(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{11}$") & (check_digit(c, FIRST_WEIGHTS) == _digit(c, 9)) & (check_digit(c, SECOND_WEIGHTS) == _digit(c, 10)), F.lit(False))


def valid_orgnr(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{9}$") & (check_digit(c, ORG_WEIGHTS) == _digit(c, 8)), F.lit(False))


def has_decimal(c: Column) -> Column:
    return c.rlike("[0-9][.,][0-9]")


def has_org_word(c: Column) -> Column:
    return c.rlike(ORG_WORDS)


def digit_runs(c: Column) -> Column:
    """Array of maximal digit runs with gaps of at most two separators, digits only."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([0-9](?:[ .,_-]{0,2}[0-9])*)")), lambda r: F.regexp_replace(r, "[^0-9]", ""))


def longest_digits(c: Column) -> Column:
    """Length of the longest plain run of digits, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)")), lambda r: F.length(r))), F.lit(0))


def has_caption(c: Column) -> Column:
    """An identity-number caption and an isolated run of five digits."""
    return c.rlike(CAPTION) & c.rlike(FIVE_RUN)


def find_numbers(c: Column, mod11: bool = True) -> Column:
    """Array of struct(start, end, digits): the sliding scan over digit positions, as a fold in the JVM.

    The eleven next digits are a hit when no gap is longer than two separator
    characters, at most three positions have a gap, and the digits have identity form
    (and right check digits); a hit is consumed, a miss slides by one digit.
    """
    folded = as_digits(c)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(folded, i, F.lit(1)).between("0", "9"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,digits:string>>)")

    def windows(pos: Column) -> Column:
        """struct(i, start, end, digits) of each run of eleven positions whose gaps are allowed."""
        last = lambda i: F.element_at(pos, i + 10)

        def gap(i: Column, j: Column) -> Column:
            a, b = F.element_at(pos, i + j), F.element_at(pos, i + j + 1)
            return F.substr(c, a + 1, b - a - 1)

        # the span bounds what eleven digits and three gaps of two can take, before any text is cut
        spans = F.filter(F.sequence(F.lit(1), F.size(pos) - 10), lambda i: last(i) - F.element_at(pos, i) <= 16)
        gaps = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: gap(i, j)), lambda g: g != "")
        near = lambda i: F.exists(F.array(gaps(i)), lambda gs: (F.size(gs) <= 3) & F.forall(gs, lambda g: (F.length(g) <= 2) & (F.translate(g, GAP, "") == "")))
        digits = lambda i: F.array_join(F.transform(F.slice(pos, i, 11), lambda p: F.substr(folded, p, F.lit(1))), "")
        return F.transform(F.filter(spans, near), lambda i: F.struct(i.alias("i"), (F.element_at(pos, i) - 1).alias("start"), last(i).alias("end"), digits(i).alias("digits")))

    def scan(pos: Column) -> Column:
        good = F.filter(windows(pos), lambda w: identity_form(w["digits"]) & (valid_mod11(w["digits"]) if mod11 else F.lit(True)))

        def step(state: Column, w: Column) -> Column:
            hit = w["i"] >= state["next"]
            found = F.struct(w["start"].alias("start"), w["end"].alias("end"), w["digits"].alias("digits"))
            return F.struct(F.when(hit, w["i"] + 11).otherwise(state["next"]).alias("next"), F.when(hit, F.concat(state["hits"], F.array(found))).otherwise(state["hits"]).alias("hits"))

        return F.aggregate(good, F.struct(F.lit(1).alias("next"), empty.alias("hits")), step, lambda s: s["hits"])

    # the pattern keeps the fold from the many texts that can't hold a hit; the one-element array names the positions once
    folded_once = F.element_at(F.transform(F.array(places), lambda pos: F.when(F.size(pos) >= 11, scan(pos)).otherwise(empty)), 1)
    return F.when(c.rlike(ELEVEN), folded_once).otherwise(empty)


def has_candidate(c: Column) -> Column:
    return F.size(find_numbers(c, mod11=False)) > 0


def protects(*texts: Column, caption: bool = True) -> Column:
    """Whether any reading holds a number of identity form, or (with caption) a caption and five digits."""
    out = F.lit(False)
    for t in texts:
        text = F.coalesce(t, F.lit(""))
        out = out | has_candidate(text)
        if caption:
            out = out | has_caption(text)
    return out


# The strict writing of an identity number, and what exempts a line.
STRICT = r"(?<![0-9])([0-9]{2}[ .-]?[0-9]{2}[ .-]?[0-9]{2}[ .-]?[0-9]{5})(?![0-9])"
EXEMPT = "fnr-ok"


def strict_numbers(c: Column) -> Column:
    """Array of struct(line, column, kind) over the lines of a text: 'dd mm yy nnnnn' with at most one separator between the parts, no digit beside it, both check digits right and a date that exists.

    Lines and columns count from 1; a line that holds the exempting mark has none.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"))), lambda l: l["t"].rlike(STRICT) & ~l["t"].contains(EXEMPT))

    def of_line(l: Column) -> Column:
        # the window before the column tells whether a digit stands there
        at = F.filter(F.sequence(F.lit(1), F.length(l["t"])), lambda i: F.substr(l["t"], i, F.lit(15)).rlike(r"^[0-9]{2}[ .-]?[0-9]{2}[ .-]?[0-9]{2}[ .-]?[0-9]{5}(?![0-9])") & ((i == 1) | ~F.substr(l["t"], i - 1, F.lit(1)).rlike("[0-9]")))
        digits = lambda i: F.substring(F.regexp_replace(F.substr(l["t"], i, F.lit(14)), "[^0-9]", ""), 1, 11)
        found = F.transform(at, lambda i: F.struct(l["n"].alias("line"), i.cast("int").alias("column"), digits(i).alias("d")))
        good = F.filter(found, lambda h: valid_mod11(h["d"]) & birth_date(h["d"]).isNotNull())
        return F.transform(good, lambda h: F.struct(h["line"].alias("line"), h["column"].alias("column"), number_kind(h["d"]).alias("kind")))

    return F.flatten(F.transform(lines, of_line))


def birth_date(d: Column) -> Column:
    """The date inside eleven digits, null where there is none: D-numbers have day + 40, h-numbers month + 40, synthetic ones month + 80."""
    day, month, year, series = (F.substring(d, s, n).try_cast("int") for s, n in ((1, 2), (3, 2), (5, 2), (7, 3)))
    day = F.when(day.between(41, 71), day - 40).otherwise(day)
    month = F.when(month.between(81, 92), month - 80).when(month.between(41, 52), month - 40).otherwise(month)
    century = F.when(series < 500, 1900).when((series < 750) & (year >= 54), 1800).when(year < 40, 2000).when(series >= 900, 1900)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", century + year, month, day), "yyyy-MM-dd")


def number_kind(d: Column) -> Column:
    """fnr, d-nummer, h-nummer or synthetic, from the day and month digits."""
    day, month = F.substring(d, 1, 2).try_cast("int"), F.substring(d, 3, 2).try_cast("int")
    return F.when(month.between(81, 92), "synthetic").when(month.between(41, 52), "h-nummer").when(day.between(41, 71), "d-nummer").otherwise("fnr")


def register(spark: SparkSession) -> None:
    """SQL functions valid_mod11, valid_orgnr, identity_form, find_fnr and iou, as SQL expressions where SQL allows."""
    from kvern.functions import scalar, text

    spark.udf.register("valid_mod11", scalar.valid_mod11_udf)
    spark.udf.register("valid_orgnr", scalar.valid_orgnr_udf)
    spark.udf.register("find_fnr", scalar.find_numbers_udf)
    spark.udf.register("poisson_upper", scalar.poisson_upper_udf)
    spark.sql(f"create or replace temporary function parse_answer(raw string) returns {text.ANSWER} return {text.ANSWER_SQL}")
    spark.sql(
        """create or replace temporary function iou(ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double) returns double
        return case when least(ax1, bx1) > greatest(ax0, bx0) and least(ay1, by1) > greatest(ay0, by0)
        then (least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0))
             / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - (least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0)))
        else 0.0 end"""
    )


HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("digits", T.StringType())]))
