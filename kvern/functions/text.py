"""Text helpers as Columns: answers, conditions, keys, masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def first_number_masked(c: Column) -> Column:
    """The first number of the text as N."""
    return F.regexp_replace(c, r"(?s)^([^0-9.]*)[0-9.]+(.*)$", "$1N$2")


def log_safe(c: Column, most: int = 100) -> Column:
    """White space collapsed, cut to `most` characters, 'none' for null and blank."""
    return F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most), F.lit("")), F.lit("none"))


def checklist(c: Column) -> Column:
    return F.substring(F.translate(F.trim(F.coalesce(c, F.lit(""))), "\n", " "), 1, 300)


def safe_key(c: Column) -> Column:
    """Whether the text can name a cache file."""
    return c.rlike("^[A-Za-z0-9_][A-Za-z0-9._-]*$")


def has_code(c: Column, code: str) -> Column:
    """Whether a comma-separated list holds the code as the first word of an entry."""
    return F.exists(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.substring_index(F.trim(p), " ", 1) == code)


_OPERATORS = ("!=", ">=", "<=", "=", ">", "<")


def condition(df: DataFrame, said: str) -> Column:
    """A Column of 'column{!=,>=,<=,=,>,<}value': numbers compare as numbers where both sides are, else as text; a blank never matches."""
    for op in _OPERATORS:
        name, found, value = said.partition(op)
        if found:
            break
    else:
        raise ValueError(f"no comparison in {said!r}")
    name, value = name.strip(), value.strip()
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    left = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
    compare = {"!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}[op]
    as_text = compare(left, F.lit(value))
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
        number = left.try_cast("double")
        return F.coalesce(F.when(number.isNotNull(), compare(number, F.lit(float(value)))).otherwise(as_text), F.lit(False))
    return F.coalesce(as_text, F.lit(False))


# The fields of an answer, and what is said of one that can't be read.
ANSWER_FIELDS = ("linjen", "sifre_paa_linjen", "dato_gyldig", "holdepunkt")
EMPTY, OMITTED, KEYWORD, UNPARSABLE = "empty answer", "the model omitted the «svar» field — the rest of the JSON came", "not JSON, read by keyword", "unparsable answer"
ANSWER = "struct<" + ",".join(f"{f}:string" for f in ("svar", "tall", "begrunnelse", "feil", *ANSWER_FIELDS)) + ">"


def _answer_sql() -> str:
    """The parser as one SQL expression over `raw`: names are bound by lambdas over one-element arrays, so that nothing is read twice."""

    def let(name: str, value: str, inner: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {inner}), 1)"

    said = lambda name, none: f"case when schema_of_variant(variant_get(d, '$.{name}')) = 'VOID' then {none} else coalesce(trim(both from regexp_replace(try_variant_get(d, '$.{name}', 'string'), '^\\\\s+|\\\\s+$', '')), '') end"
    listed = lambda name: f"substring(replace({said(name, repr(''))}, '\\n', ' '), 1, 300)"
    error = f"case when a in ('ja', 'nei') then '' when a = '' then '{OMITTED}' else concat('unknown answer \\'', a, '\\'') end"
    pair = lambda name, value: f"'{name}', {value}"
    checks = ", ".join(pair(f, listed(f)) for f in ANSWER_FIELDS)
    blank = ", ".join(pair(f, "''") for f in ANSWER_FIELDS)
    of_object = let("a", f"lower({said('svar', repr('none'))})", f"named_struct('svar', case when a = 'nei' then 'nei' else 'ja' end, 'tall', {said('tall', repr('None'))}, 'begrunnelse', {said('begrunnelse', repr('None'))}, 'feil', {error}, {checks})")
    other = let(
        "w", r"lower(regexp_extract(c, '(?i)\\b(ja|nei)\\b', 1))",
        f"case when w <> '' then named_struct('svar', w, 'tall', '', 'begrunnelse', substring(c, 1, 120), 'feil', '{KEYWORD}', {blank}) else named_struct('svar', 'ja', 'tall', '', 'begrunnelse', substring(c, 1, 120), 'feil', '{UNPARSABLE}', {blank}) end",
    )
    objects = r"filter(array(try_parse_json(c), try_parse_json(regexp_extract(c, '(?s)(\\{.*?\\})', 1))), v -> v is not null and schema_of_variant(v) like 'OBJECT%')"
    clean = let("s", r"regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '')", r"case when s like '```%' then regexp_replace(regexp_replace(s, '^```[a-zA-Z]*\\s*|\\s*```$', ''), '^\\s+|\\s+$', '') else s end")
    read = let("o", objects, f"case when size(o) > 0 then {let('d', 'o[0]', of_object)} else {other} end")
    return let("c", clean, f"case when c = '' and coalesce(raw, '') rlike '^\\\\s*$' then named_struct('svar', 'ja', 'tall', '', 'begrunnelse', '', 'feil', '{EMPTY}', {blank}) else {read} end")


#: struct(svar, tall, begrunnelse, feil and the checklist fields) of a raw answer: code fence, JSON, first object, keyword; what can't be read is ja, never nei.
ANSWER_SQL = _answer_sql()


def with_answer(df: DataFrame, column: str, name: str = "answer") -> DataFrame:
    """df with the parsed answer of a text column."""
    kept = df.columns
    return df.withColumn("raw", F.col(column)).withColumn("_answer", F.expr(ANSWER_SQL)).select(*kept, F.col("_answer").alias(name))
