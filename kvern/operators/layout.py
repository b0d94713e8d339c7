"""Page layout: tokens to lines, lines to redaction boxes, merging with detector boxes.

Only the grouping of tokens into lines runs in Python, one page a group: it depends on
the order of the tokens, and a page holds what fits on a sheet. Everything after it is
Columns over the digit positions of a line. Ties in every order are broken by `ord`.

Tokens are doc, page, ord, text, x0, y0, x1, y1, rec_score; detector boxes doc, page, ord,
x0, y0, x1, y1, conf.
"""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions import numbers
from kvern.functions.geometry import Box, covered_share, intersection_area, smallest_share

# Digits to cover, paddings, height cap, overlap of duplicates, detector confidence floors, and lenient limits.
COVERED_DIGITS, PAD_X, PAD_Y, HEIGHT_CAP = 5, 0.35, 0.35, 3.0
DUPLICATE, CONF_VERTICAL, CONF_NO_TEXT, VERTICAL, MIN_DIGITS, MAX_LETTERS = 0.5, 0.02, 0.02, 1.3, 1, 1
FREE_GAPS = (2, 4, 6)
IN_BOX = 0.3

PAGE = ["doc", "page"]
BOX = ["x0", "y0", "x1", "y1"]
_DIGIT = "struct<pos:int,left:double,right:double,top:double,bottom:double,rec:double>"


# ----- lines

def with_lines(tokens: DataFrame) -> DataFrame:
    """tokens with line_no, from 0 in order of creation.

    Tokens by centre height (then x0) join the earliest line whose vertical reach holds their centre; a line's reach grows
    with its tokens. As centres come in rising order, a line that ends above the current centre can't be joined again.
    """
    kinds = dict(tokens.dtypes)
    names = [*PAGE, "ord", "text", *BOX, "rec_score"]

    def assign(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(_c=(page["y0"] + page["y1"]) / 2).sort_values(["_c", "x0", "ord"], kind="stable")
        top, bottom, open_, out = [], [], [], []
        for c, y0, y1 in zip(page["_c"], page["y0"], page["y1"]):
            open_ = [i for i in open_ if bottom[i] >= c]
            at = next((i for i in open_ if top[i] <= c), None)
            if at is None:
                at = len(top)
                top.append(y0)
                bottom.append(y1)
                insort(open_, at)
            else:
                top[at], bottom[at] = min(top[at], y0), max(bottom[at], y1)
            out.append(at)
        return page.assign(line_no=out)[[*names, "line_no"]]

    return tokens.select(*names).groupBy(*PAGE).applyInPandas(assign, ", ".join(f"{n} {kinds[n]}" for n in names) + ", line_no int")


def lines(tokens: DataFrame) -> DataFrame:
    """doc, page, line_no, top, bottom, text, n_tokens, rec_min_linje, digits of each line.

    text joins the tokens from left to right by one space. digits are the characters that read as digits: position (from
    1), their part of the token's box and its score, in order.
    """
    return _line_rows(with_lines(tokens))


def _line_rows(placed: DataFrame) -> DataFrame:
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(*PAGE, "line_no").orderBy("x0", "ord").rowsBetween(Window.unboundedPreceding, -1))
    at = placed.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))
    step = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    folded = numbers.as_digits(F.col("text"))

    def digit(i: Column) -> Column:
        return F.struct(
            (F.col("start") + i).alias("pos"), (F.col("x0") + step * (i - 1)).alias("left"), (F.col("x0") + step * i).alias("right"),
            F.col("y0").alias("top"), F.col("y1").alias("bottom"), F.col("rec_score").alias("rec"),
        )

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substr(folded, i, F.lit(1)).between("0", "9"))
    ready = at.select(*PAGE, "line_no", "x0", "ord", "text", "y0", "y1", "rec_score", F.transform(places, digit).alias("digits"))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "ord", "text", "digits")))
    rows = ready.groupBy(*PAGE, "line_no").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.round(F.min(_score("rec_score")), 5).alias("rec_min_linje"), F.count(F.lit(1)).cast("int").alias("n_tokens"), ordered.alias("t"))
    return rows.select(
        *PAGE, "line_no", "top", "bottom", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("text"), "n_tokens", "rec_min_linje",
        F.flatten(F.transform("t", lambda t: t["digits"])).alias("digits"),
    )


def _score(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def lines_from_tokens(tokens: DataFrame) -> DataFrame:
    """doc, page, line_no, text, n_tokens, n_digits of each line."""
    return lines(tokens).select(*PAGE, "line_no", "text", "n_tokens", F.size("digits").alias("n_digits"))


def marked_lines(tokens: DataFrame) -> DataFrame:
    """doc, page, line_no, text, marks: the lines with text, numbered from 1 in order of their tops, each with its number-shaped hits (digits, mod11)."""
    rows = lines(tokens).withColumn("text", F.trim("text")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "line_no"))
    marks = F.transform(numbers.find_numbers(F.col("text")), lambda h: F.struct(h["digits"].alias("digits"), numbers.valid_mod11(h["digits"]).alias("mod11")))
    return rows.select(*PAGE, number.alias("line_no"), "text", marks.alias("marks"))


# ----- redaction boxes

def _middle(values: Column, n: int) -> Column:
    """The median of an array of n values, n odd."""
    return F.element_at(F.array_sort(values), n // 2 + 1)


def redaction_boxes(lines_: DataFrame, mod11: bool = True) -> DataFrame:
    """doc, page, line_no, x0, y0, x1, y1, mod11, rec, maks_luke, har_desimal_luke: one box per found number of a line.

    The box covers the last five of the eleven digits, from half-way to the digit before them. maks_luke is the widest gap
    between neighbouring digits in digit widths, har_desimal_luke whether a decimal mark stands between them; gaps after
    the 2nd, 4th and 6th digit don't count, as dates are written with them.
    """
    hits = lines_.select(*PAGE, "line_no", "text", "digits", F.explode(numbers.find_numbers(F.col("text"), mod11)).alias("hit"))
    held = F.filter("digits", lambda d: (d["pos"] > F.col("hit.start")) & (d["pos"] <= F.col("hit.end")))
    found = hits.select(*PAGE, "line_no", "text", F.col("hit.digits").alias("digits"), held.alias("d"))
    d = [F.element_at("d", i) for i in range(1, 12)]
    tail, anchor = d[-COVERED_DIGITS:], d[-COVERED_DIGITS - 1]
    width = _middle(F.array(*[t["right"] - t["left"] for t in tail]), COVERED_DIGITS)
    top, bottom = (_middle(F.array(*[x[side] for x in d]), 11) for side in ("top", "bottom"))
    pairs = [(a, b) for i, (a, b) in enumerate(zip(d, d[1:]), 1) if i not in FREE_GAPS]
    found = found.select(
        *PAGE, "line_no", "digits", "d", width.alias("w"), top.alias("t"), bottom.alias("b"), _middle(F.array(*[x["right"] - x["left"] for x in d]), 11).alias("unit"),
        F.greatest(F.lit(0.0), *[b["left"] - a["right"] for a, b in pairs]).alias("gap"),
        F.greatest(*[F.substr(F.col("text"), a["pos"] + 1, b["pos"] - a["pos"] - 1).rlike("[.,]").cast("double") for a, b in pairs]).alias("har_desimal_luke"),
    )
    middle, half = (F.col("t") + F.col("b")) / 2, F.least((F.col("b") - F.col("t")) * (0.5 + PAD_Y), HEIGHT_CAP * F.col("w") / 2)
    left = F.greatest((anchor["right"] + tail[0]["left"]) / 2 - PAD_X * F.col("w"), (anchor["left"] + anchor["right"]) / 2)
    right = F.greatest(*[t["right"] for t in tail]) + PAD_X * F.col("w")
    whole = lambda c, name: c.cast("double").alias(name)
    return found.select(
        *PAGE, "line_no", whole(F.floor(left), "x0"), whole(F.floor(middle - half), "y0"), whole(F.ceil(right), "x1"), whole(F.ceil(middle + half), "y1"), numbers.valid_mod11(F.col("digits")).alias("mod11"),
        F.round(F.array_min(F.transform("d", lambda x: F.when(~F.isnan(x["rec"]), x["rec"]))), 3).alias("rec"), F.round(F.col("gap") / F.when(F.col("unit") == 0, 1.0).otherwise(F.col("unit")), 2).alias("maks_luke"), "har_desimal_luke",
    )


def candidate_boxes(lines_: DataFrame) -> DataFrame:
    """doc, page, x0, y0, x1, y1 of each run of eleven digits of identity form, rx0, ry0, rx1, ry1 of its last five digits, n_digits, mod11."""
    hits = lines_.select(*PAGE, "digits", F.explode(numbers.find_numbers(F.col("text"), mod11=False)).alias("hit"))
    held = F.filter("digits", lambda d: (d["pos"] > F.col("hit.start")) & (d["pos"] <= F.col("hit.end")))
    found = hits.select(*PAGE, F.col("hit.digits").alias("said"), held.alias("d"), F.slice(held, -COVERED_DIGITS, COVERED_DIGITS).alias("r"))
    edges = (("x0", F.array_min, "left"), ("y0", F.array_min, "top"), ("x1", F.array_max, "right"), ("y1", F.array_max, "bottom"))

    def edge(c: str, f, side: str) -> Column:
        return f(F.transform(c, lambda x: x[side]))

    sides = [edge(c, f, side).alias(p + n) for c, p in (("d", ""), ("r", "r")) for n, f, side in edges]
    return found.select(*PAGE, *sides, F.size("d").alias("n_digits"), numbers.valid_mod11(F.col("said")).alias("mod11"))


# ----- detector boxes

def _same_page(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc") == F.col(f"{b}.doc")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def box_text_features(tokens: DataFrame, detected: DataFrame) -> DataFrame:
    """doc, page, ord, har_tokens, n_siffer, n_bokstaver, rec_min, rec_median of each detector box from the tokens that lie in it by more than 0.3; letters count in tokens with a digit only."""
    t, d = tokens.alias("t"), detected.alias("d")
    within = _same_page("t", "d") & (covered_share(Box.of("t."), Box.of("d.")) > IN_BOX)
    digits = F.length(F.regexp_replace("t.text", "[^0-9]", ""))
    letters = F.length(F.regexp_replace("t.text", r"[^\p{L}]", ""))
    return d.join(t, within, "left").groupBy("d.doc", "d.page", "d.ord").agg(
        F.max(F.col("t.text").isNotNull().cast("int")).alias("har_tokens"), F.coalesce(F.sum(digits), F.lit(0)).cast("int").alias("n_siffer"),
        F.coalesce(F.sum(F.when(digits > 0, letters)), F.lit(0)).cast("int").alias("n_bokstaver"), F.round(F.min(_score("t.rec_score")), 5).alias("rec_min"), F.round(F.median(_score("t.rec_score")), 5).alias("rec_median"),
    )


def accepted(detected: DataFrame, tokens: DataFrame) -> DataFrame:
    """detected with kilde: yolo_vertikal, yolo or null; tall boxes and boxes without text need some confidence, text needs digits and few letters."""
    counts = box_text_features(tokens, detected)
    tall = (F.col("y1") - F.col("y0")) > VERTICAL * (F.col("x1") - F.col("x0"))
    kilde = (
        F.when(tall, F.when(F.col("conf") >= CONF_VERTICAL, "yolo_vertikal"))
        .when(F.col("har_tokens") == 1, F.when((F.col("n_siffer") >= MIN_DIGITS) & (F.col("n_bokstaver") <= MAX_LETTERS), "yolo"))
        .when(F.col("conf") >= CONF_NO_TEXT, "yolo")
    )
    return detected.join(counts, [*PAGE, "ord"], "left").select(*detected.columns, kilde.alias("kilde"))


def merge_boxes(tokens: DataFrame, detected: DataFrame) -> DataFrame:
    """The boxes of every page from its text and its detector boxes: doc, page, x0..y1, kilde, conf, rec, mod11, maks_luke, har_desimal_luke.

    A detector box that overlaps text boxes makes them 'begge' with the confidence of the last such box; one that overlaps
    only a kept detector box before it is a duplicate; any other must be accepted.
    """
    text = redaction_boxes(lines(tokens)).withColumn("no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", *BOX)))
    a, b = text.alias("a"), detected.alias("b")
    near = a.join(b, _same_page("a", "b") & (smallest_share(Box.of("b."), Box.of("a.")) > DUPLICATE)).select("a.doc", "a.page", "a.no", "b.ord", "b.conf")
    promoted = near.groupBy(*PAGE, "no").agg(F.round(F.max_by("conf", "ord"), 3).alias("conf"))
    on_text = text.join(promoted, [*PAGE, "no"], "left").select(
        *PAGE, *BOX, F.when(F.col("conf").isNull(), "paddle").otherwise("begge").alias("kilde"), "conf", "rec", "mod11", "maks_luke", "har_desimal_luke",
    )
    rest = accepted(detected.join(near.select(*PAGE, "ord").distinct(), [*PAGE, "ord"], "left_anti"), tokens).where("kilde is not null")
    box = F.struct("ord", *BOX, "conf", "kilde")
    kind = "array<struct<ord:int,x0:double,y0:double,x1:double,y1:double,conf:double,kilde:string>>"
    of = lambda s: Box(*(s[c] for c in BOX))
    first = F.aggregate(F.array_sort(F.collect_list(box)), F.expr(f"cast(array() as {kind})"), lambda kept, x: F.when(F.exists(kept, lambda k: smallest_share(of(x), of(k)) > DUPLICATE), kept).otherwise(F.concat(kept, F.array(x))))
    alone = rest.withColumn("ord", F.col("ord").cast("int")).groupBy(*PAGE).agg(first.alias("kept")).select(*PAGE, F.explode("kept").alias("k"))
    none = F.lit(None).cast("double")
    return on_text.union(alone.select(*PAGE, *[F.col(f"k.{c}").alias(c) for c in BOX], F.col("k.kilde").alias("kilde"), F.round("k.conf", 3).alias("conf"), none.alias("rec"), F.lit(None).cast("boolean").alias("mod11"), none.alias("maks_luke"), none.alias("har_desimal_luke")))


def digit_spans(text: Column, digits: Column, gap: int) -> Column:
    """Array of struct(digits, left, right, last): runs of ASCII digits with at most `gap` separators between neighbours."""
    plain = F.filter(digits, lambda d: F.substr(text, d["pos"], F.lit(1)).between("0", "9"))
    empty = F.expr("cast(array() as array<struct<digits:string,left:double,right:double,last:int>>)")

    def step(runs: Column, d: Column) -> Column:
        c, end = F.substr(text, d["pos"], F.lit(1)), F.element_at(runs, -1)
        between = F.substr(text, end["last"] + 1, d["pos"] - end["last"] - 1)
        joins = (F.size(runs) > 0) & (F.length(between) <= gap) & (F.translate(between, numbers.GAP, "") == "")
        grown = F.struct(F.concat(end["digits"], c).alias("digits"), F.least(end["left"], d["left"]).alias("left"), F.greatest(end["right"], d["right"]).alias("right"), d["pos"].alias("last"))
        new = F.struct(c.alias("digits"), d["left"].alias("left"), d["right"].alias("right"), d["pos"].alias("last"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(new)))

    return F.when(F.size(plain) > 0, F.aggregate(plain, empty, step)).otherwise(empty)


def _decimals(text: Column) -> Column:
    """Positions of the first characters of digit, mark, digit, from left to right without overlap."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)).rlike("^[0-9][.,][0-9]$"))
    empty = F.expr("cast(array() as array<int>)")
    return F.aggregate(starts, empty, lambda kept, i: F.when((F.size(kept) > 0) & (i < F.element_at(kept, -1) + 3), kept).otherwise(F.concat(kept, F.array(i))))


_ZERO = ("n_siffer_linje", "siffer_run", "har_fnr_kandidat", "har_desimal_naer", "har_00_run", "har_orgnr", "lang_run")


def box_features(tokens: DataFrame, detected: DataFrame) -> DataFrame:
    """doc, page, ord and the fourteen text features of every detector box: what is in it, and what of its line reaches over it.

    A box's line is the one whose tokens overlap it most (the earliest on ties); without one the features of the line are 0.
    """
    placed = with_lines(tokens)
    rows = _line_rows(placed)
    t, d = placed.alias("t"), detected.alias("d")
    shares = t.join(d, _same_page("t", "d")).groupBy("d.doc", "d.page", "d.ord", "t.line_no").agg(F.sum(intersection_area(Box.of("t."), Box.of("d."))).alias("a")).where("a > 0")
    own = shares.groupBy(*PAGE, "ord").agg(F.max_by("line_no", F.struct("a", -F.col("line_no"))).alias("line_no"))
    over = lambda s: (s["right"] > F.col("x0")) & (s["left"] < F.col("x1"))
    text, digits = F.col("text"), F.col("digits")
    spans = lambda first, last: F.filter(digits, lambda g: (g["pos"] >= first) & (g["pos"] <= last))
    reaches = lambda g: (F.size(g) > 0) & (F.array_max(F.transform(g, lambda x: x["right"])) > F.col("x0")) & (F.array_min(F.transform(g, lambda x: x["left"])) < F.col("x1"))
    flag = lambda c: c.cast("int")
    longest = lambda runs: F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r["digits"]))), F.lit(0))
    lined = detected.join(own, [*PAGE, "ord"]).join(rows, [*PAGE, "line_no"]).withColumns({"runs": F.filter(digit_spans(text, digits, 2), over), "plain": F.filter(digit_spans(text, digits, 0), over)})
    org = lambda r: F.when(F.length(r["digits"]) == 9, r["digits"]).when((F.length(r["digits"]) == 11) & r["digits"].startswith("00"), F.substring(r["digits"], 3, 9))
    of_line = lined.select(
        *PAGE, "ord", "rec_min_linje", F.length(F.regexp_replace("text", "[^0-9]", "")).alias("n_siffer_linje"), longest(F.col("plain")).alias("siffer_run"),
        flag(F.exists(numbers.find_numbers(text, mod11=False), lambda h: reaches(spans(h["start"] + 1, h["end"])))).alias("har_fnr_kandidat"), flag(F.exists(_decimals(text), lambda i: reaches(spans(i, i + 2)))).alias("har_desimal_naer"),
        flag(F.exists("runs", lambda r: F.length(r["digits"]).between(10, 12) & r["digits"].startswith("00"))).alias("har_00_run"),
        flag(F.exists("runs", lambda r: F.coalesce(org(r).rlike("^[89]") & numbers.valid_orgnr(org(r)), F.lit(False)))).alias("har_orgnr"), longest(F.col("runs")).alias("lang_run"),
    )
    middle, reach = (F.col("l.top") + F.col("l.bottom")) / 2, 1.5 * (F.col("d.y1") - F.col("d.y0"))
    near = d.join(rows.where(numbers.has_org_word(text)).alias("l"), _same_page("d", "l") & middle.between(F.col("d.y0") - reach, F.col("d.y1") + reach)).select("d.doc", "d.page", "d.ord")
    on_own = lined.where(numbers.has_org_word(text)).select(*PAGE, "ord")
    org_word = near.union(on_own).distinct().withColumn("har_org_ord", F.lit(1))
    all_ = box_text_features(tokens, detected).join(of_line, [*PAGE, "ord"], "left").join(org_word, [*PAGE, "ord"], "left")
    return all_.na.fill(0, [*_ZERO, "har_org_ord"]).select(*PAGE, "ord", "har_tokens", "n_siffer", "n_bokstaver", *_ZERO[:2], *_ZERO[2:6], "har_org_ord", "lang_run", "rec_min", "rec_median", "rec_min_linje")


# ----- the text around a box

def context(tokens: DataFrame, boxes: DataFrame, n_lines: int = 0) -> DataFrame:
    """doc, page, ord, boks_tekst, linje_tekst, blokk_tekst of boxes (doc, page, ord, x0..y1).

    A token is on the box's line where it overlaps it vertically by more than 0.3 of the lower of both heights, and in the
    box where it also overlaps horizontally. The block is the line of most vertical overlap with n_lines lines on both
    sides; its lines are grouped by overlap (0.3 of the lower height), not by centres.
    """
    some = tokens.where(F.trim("text") != "")
    t, b = some.alias("t"), boxes.alias("b")
    overlap = F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")
    lower = F.least(F.greatest(F.col("b.y1") - F.col("b.y0"), F.lit(1.0)), F.greatest(F.col("t.y1") - F.col("t.y0"), F.lit(1.0)))
    inside = F.least("b.x1", "t.x1") > F.greatest("b.x0", "t.x0")
    held = b.join(t, _same_page("b", "t") & (overlap > 0.3 * lower)).select("b.doc", "b.page", "b.ord", F.struct("t.x0", F.col("t.ord").alias("o"), "t.text").alias("s"), inside.alias("inside"))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["text"]), " ")
    near = held.groupBy(*PAGE, "ord").agg(said(F.when(F.col("inside"), F.col("s"))).alias("boks_tekst"), said(F.col("s")).alias("linje_tekst"))
    out = boxes.select(*PAGE, "ord").join(near, [*PAGE, "ord"], "left").na.fill("", ["boks_tekst", "linje_tekst"])
    if not n_lines:
        return out.withColumn("blokk_tekst", F.lit(""))
    rows = _overlap_lines(some)
    l = rows.alias("l")
    most = F.least("b.y1", "l.y1") - F.greatest("b.y0", "l.y0")
    own = b.join(l, _same_page("b", "l")).groupBy("b.doc", "b.page", "b.ord").agg(F.max_by("l.at", F.struct(most, -F.col("l.at"))).alias("at"))
    page = rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("texts"))
    first = F.greatest(F.col("at") - n_lines, F.lit(0))
    block = own.join(page, PAGE).select(*PAGE, "ord", F.array_join(F.slice("texts", first + 1, F.col("at") + n_lines + 1 - first), "\n").alias("blokk_tekst"))
    return out.join(block, [*PAGE, "ord"], "left").na.fill("", ["blokk_tekst"])


def _overlap_lines(tokens: DataFrame) -> DataFrame:
    """doc, page, at, y0, y1, text: tokens from top to bottom join the earliest line they overlap by more than 0.3 of the lower height; at numbers the lines by their tops."""

    def group(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for y0, y1, x0, order, text in sorted(zip(page["y0"], page["y1"], page["x0"], page["ord"], page["text"]), key=lambda r: (r[0], r[3])):
            home = next((f for f in found if min(f[1], y1) - max(f[0], y0) > 0.3 * max(min(f[1] - f[0], y1 - y0), 1.0)), None)
            if home is None:
                found.append([y0, y1, [(x0, order, text)]])
            else:
                home[0], home[1] = min(home[0], y0), max(home[1], y1)
                home[2].append((x0, order, text))
        found.sort(key=lambda f: f[0])
        return pd.DataFrame([(*key, i, y0, y1, " ".join(t for _, _, t in sorted(some))) for i, (y0, y1, some) in enumerate(found)], columns=["doc", "page", "at", "y0", "y1", "text"])

    kinds = dict(tokens.dtypes)
    return tokens.groupBy(*PAGE).applyInPandas(group, f"doc {kinds['doc']}, page {kinds['page']}, at int, y0 double, y1 double, text string")


def guard_lines(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, page, ord, linje: the text of the line of most vertical overlap with each box (the earliest on ties), blank without one."""
    l, b = lines(tokens).alias("l"), boxes.alias("b")
    overlap = F.least("b.y1", "l.bottom") - F.greatest("b.y0", "l.top")
    best = b.join(l, _same_page("b", "l") & (overlap > 0)).groupBy("b.doc", "b.page", "b.ord").agg(F.max_by("l.text", F.struct(overlap, -F.col("l.line_no"))).alias("linje"))
    return boxes.select(*PAGE, "ord").join(best, [*PAGE, "ord"], "left").na.fill("", ["linje"])


def text_tokens(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Tokens of plain text laid out on a grid: one line per 60 px, 28 px a character, 50 px high; doc is the id, page is 1."""
    return placed_tokens(texts.select(F.col(id_column).alias("doc"), F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("no"), F.col(text_column).alias("content")))


def placed_tokens(texts: DataFrame) -> DataFrame:
    """Tokens of texts (doc, page, x, y, no, content) on the same grid from (x, y) on; no orders the texts of a page."""
    rows = texts.select("doc", "page", "x", "y", "no", F.posexplode(F.split("content", "\n")).alias("line", "content"))
    pieces = F.filter(F.transform(F.split("content", " "), lambda w, i: F.struct(w.alias("text"), i.alias("i"))), lambda s: s["text"] != "")
    start = lambda i: F.length(F.array_join(F.slice(F.split("content", " "), 1, i), " ")) + F.when(i > 0, 1).otherwise(0)
    rows = rows.select("doc", "page", "x", "y", "no", "line", "content", F.explode(pieces).alias("p")).select("doc", "page", "x", "y", "no", "line", "p.text", "p.i", start(F.col("p.i")).alias("at"))
    x0, y0 = F.col("x") + F.col("at") * 28, F.col("y") + F.col("line") * 60
    order = F.row_number().over(Window.partitionBy("doc", "page").orderBy("no", "line", "i")).cast("int") - 1
    return rows.select("doc", "page", order.alias("ord"), "text", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.length("text") * 28).cast("double").alias("x1"), (y0 + 50).cast("double").alias("y1"), F.lit(0.99).alias("rec_score"))
