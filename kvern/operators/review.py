"""Review lists, slices and smaller reports over the views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.geometry import PX_PER_PT, Box, to_points
from kvern.operators import rules

# Document-type codes of the two profiles.
COORDINATE_CODES = ("SR_JOU", "AH_JOU", "KA_MOB", "KA_GRE", "TR_MAS", "SR_SKN", "JS_JSA", "FR_REG", "SR_UTS")
SECTIONING_CODES = ("SE_SEK",)


def profiles(meta: DataFrame) -> DataFrame:
    """doc_no, coordinates, sectioning: which rule profiles a document's codes switch on; a document without metadata has none."""
    on = lambda codes: F.arrays_overlap("codes", F.array(*map(F.lit, codes)))
    return meta.select("doc_no", on(COORDINATE_CODES).alias("coordinates"), on(SECTIONING_CODES).alias("sectioning"))


def discarded(preds: DataFrame, meta: DataFrame) -> DataFrame:
    """Predictions with `gone`: the production rules by source and document profile, then the shape limits."""
    marked = preds.join(profiles(meta), "doc_no", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("coordinates", "sectioning")})
    gone = F.lit(False)
    for name, (kilde, config) in rules.PRODUCTION.items():
        gate = F.col("coordinates") if name == "coordinates" else F.col("sectioning") if name.startswith("sectioning") else F.lit(True)
        gone = gone | (gate & (F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    for kilde, config in rules.ANY_CONFIDENCE.items():
        gone = gone | ((F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    return marked.withColumn("gone", gone | shape_discards())


def shape_discards() -> Column:
    """The shape limits behind the confidence gate; a paddle box never passes the gate, as its confidence is that of reading."""
    ungated = {k: v for k, v in rules.BEHIND_GATE.items() if k != "conf_threshold"}
    return F.when(F.col("kilde") == "paddle", rules.removed(rules.literal(ungated), F.col)).otherwise(rules.removed(rules.literal(rules.BEHIND_GATE), F.col))


def detector_only(preds: DataFrame) -> DataFrame:
    """The boxes of the detector alone (predictions columns) that its shape limits keep, as yolo: limits on any confidence, and those behind the gate."""
    alone = preds.withColumn("conf", F.round("conf", 3))
    kept = ~rules.removed(rules.literal(rules.ANY_CONFIDENCE["yolo"]), F.col) & ~rules.removed(rules.literal(rules.BEHIND_GATE), F.col)
    return alone.where(F.col("conf").isNotNull() & kept).withColumn("kilde", F.lit("yolo"))


def lost_truth(classified: DataFrame, edges: DataFrame, gone: Column) -> DataFrame:
    """label_id, pred_id: every truth box that loses all its coverers, with each of them."""
    marked = classified.select("pred_id", gone.alias("gone"))
    linked = edges.select("label_id", "pred_id").join(marked, "pred_id")
    lost = linked.groupBy("label_id").agg(F.bool_and("gone").alias("lost")).where("lost")
    return linked.join(lost, "label_id", "left_semi").select("label_id", "pred_id")


def coverage_review(matches: DataFrame, threshold: float = 0.32) -> DataFrame:
    """label_id, doc_no, side, state (uncovered, poorly covered, ok) of every truth box by its best match."""
    state = F.when(F.col("cov") <= 0, "uncovered").when(F.col("cov") < threshold, "poorly covered").otherwise("ok")
    return matches.select("label_id", "doc_no", "side", state.alias("state"))


def error_documents(labels: DataFrame) -> DataFrame:
    """doc_no, states of documents whose labels are not all accepted."""
    per = labels.groupBy("doc_no").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "", "(empty)").otherwise(F.col("status")))), ",").alias("states"))
    return per.where("states <> 'ACCEPTED'")


def manual_slice(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """decade, n, manual: labels drawn or moved by hand, per decade."""
    manual = F.col("status").isin("MANUAL", "MOVED") | ~F.col("ml")
    rows = labels.join(meta.select("doc_no", "decade"), "doc_no", "left")
    return rows.groupBy(F.coalesce(F.col("decade").cast("string"), F.lit("ukjent")).alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.sum(manual.cast("bigint")).alias("manual"))


def thin_pages(pages: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """doc_no, side, n of pages with fewer than `least` labels, pages without labels among them."""
    n = labels.groupBy("doc_no", "side").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("doc_no", "side").distinct().join(n, ["doc_no", "side"], "left").select("doc_no", "side", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def page_orientation(pages: DataFrame) -> DataFrame:
    """lying, n, share of pages by orientation."""
    rows = pages.groupBy((F.col("pw") > F.col("ph")).alias("lying")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def numbered(classified: DataFrame) -> DataFrame:
    """pred_id, nr: numbers from 1 in order of name, page, y, x, source, id; ranks run within pages and get the offsets of names and pages, so no task sorts a document or all rows."""
    pages = classified.groupBy("navn", "side").agg(F.count(F.lit(1)).alias("k"))
    inner = pages.withColumn("o3", F.coalesce(F.sum("k").over(Window.partitionBy("navn").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = pages.groupBy("navn").agg(F.sum("k").alias("k")).withColumn("head", F.substring("navn", 1, 3))
    heads = per.groupBy("head").agg(F.sum("k").alias("k"))
    first = heads.withColumn("o1", F.coalesce(F.sum("k").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    names = per.withColumn("o2", F.coalesce(F.sum("k").over(Window.partitionBy("head").orderBy("navn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = inner.join(names.join(first, "head").select("navn", (F.col("o1") + F.col("o2")).alias("o")), "navn").select("navn", "side", (F.col("o") + F.col("o3")).alias("before"))
    r = F.row_number().over(Window.partitionBy("navn", "side").orderBy("y0", "x0", "kilde", "pred_id"))
    return classified.withColumn("r", r).join(offsets, ["navn", "side"]).select("pred_id", (F.col("before") + F.col("r")).alias("nr"))


def chosen_documents(meta: DataFrame, first_year: int, last_year: int, code_pattern: str) -> DataFrame:
    """doc_no of documents in a range of years with a code that holds the pattern."""
    return meta.where(F.col("year").between(first_year, last_year) & F.exists("codes", lambda c: c.rlike(code_pattern))).select("doc_no")


def rounded_join(manifest: DataFrame, preds: DataFrame) -> DataFrame:
    """nr, pred_id of BOM rows and result rows with equal corners at one decimal."""
    on = ["doc_no", "side", *[f"k{c}" for c in ("x0", "y0", "x1", "y1")]]
    keyed = lambda d: d.withColumns({f"k{c}": F.round(F.col(c) * 10, 0).cast("bigint") for c in ("x0", "y0", "x1", "y1")})
    return keyed(manifest.where("klasse = 'BOM' and x0 is not null")).select("nr", *on).join(keyed(preds).select("pred_id", *on), on).select("nr", "pred_id")


def time_shares(verdicts: DataFrame) -> DataFrame:
    """kilde, seconds, share of the verdict time by source."""
    rows = verdicts.dropDuplicates(["verdict_id"]).where("sekunder is not null and not isnan(sekunder)").groupBy(F.coalesce(F.nullif(F.lower(F.trim("kilde")), F.lit("")), F.lit("unknown")).alias("kilde")).agg(F.round(F.sum("sekunder"), 2).alias("seconds"))
    return rows.withColumn("share", F.round(F.col("seconds") / F.sum("seconds").over(Window.partitionBy(F.lit(1))), 4))


def last_step(log: DataFrame, key: str, at: str) -> DataFrame:
    """key, seconds between the last two entries of a log, or its only value."""
    w = Window.partitionBy(key).orderBy(at)
    rows = log.select(key, at, F.lag(at).over(w).alias("prev"))
    return rows.groupBy(key).agg(F.max_by(F.struct(at, "prev"), at).alias("l")).select(key, F.round(F.coalesce(F.col(f"l.{at}") - F.col("l.prev"), F.col(f"l.{at}")), 3).alias("seconds"))


def best_epoch(rows: DataFrame, metric: str) -> DataFrame:
    """The row with the largest metric."""
    return rows.agg(F.max_by(F.struct(*rows.columns), metric).alias("b")).select("b.*")


def extended_retraction(held: DataFrame, label_id: str, replaced_by: list[str]) -> str:
    """new, extended or unchanged: what noting one more retraction does to the list (label_id, replaced_by array)."""
    row = held.where(F.col("label_id") == label_id).select("replaced_by").first()
    if row is None:
        return "new"
    return "unchanged" if set(replaced_by) <= set(row[0] or []) else "extended"


def synced_classes(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored verdict rows (nr, klasse) with the class of a newer manifest where it has the row."""
    newer = manifest.select("nr", F.col("klasse").alias("now"))
    return stored.join(newer, "nr", "left").withColumn("klasse", F.coalesce("now", "klasse")).drop("now")


def verdict_mark(gruppe: Column, svar: Column) -> Column:
    """right, missed (ja on a box without truth) or lost (nei on a covering box)."""
    return F.when((gruppe == "BOM") & (svar == "ja"), "missed").when((gruppe != "BOM") & (svar == "nei"), "lost").otherwise("right")


def per_source_spec(said: str) -> dict[str, dict[str, float]]:
    """'yolo:min_digits=5,rec_veto=0.98;paddle:max_gap=6' -> parameters per source; an unknown name is an error."""
    out: dict[str, dict[str, float]] = {}
    for part in filter(None, (p.strip() for p in said.split(";"))):
        kilde, found, rest = part.partition(":")
        if not found:
            raise ValueError(f"no source in {part!r}")
        pairs = dict(p.split("=", 1) for p in rest.split(",") if p.strip())
        out[kilde.strip().lower()] = rules.validated({k.strip(): float(v) for k, v in pairs.items()})
    return out


def diff_additions(lines: DataFrame) -> DataFrame:
    """file, line, text of the added lines of unified diffs (diff, pos, value): line numbers run from the hunk's start; each diff is ordered by itself."""
    w = Window.partitionBy("diff").orderBy("pos")
    file = F.when(F.col("value").startswith("+++ "), F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.*)$", 1))
    start = F.when(F.col("value").startswith("@@"), F.regexp_extract("value", r"\+([0-9]+)", 1).try_cast("int"))
    hunks = lines.withColumn("file", F.last(file, ignorenulls=True).over(w)).withColumn("start", F.last(start, ignorenulls=True).over(w)).withColumn("hunk", F.sum(start.isNotNull().cast("int")).over(w))
    body = hunks.where(~F.col("value").rlike(r"^(\+\+\+ |--- |@@|diff |index )") & ~F.col("value").startswith("-") & F.col("start").isNotNull())
    numbered_ = body.withColumn("line", F.col("start") + F.row_number().over(Window.partitionBy("diff", "hunk").orderBy("pos")) - 1)
    return numbered_.where(F.col("value").startswith("+")).select("file", "line", F.substring("value", 2, 1_000_000).alias("text"))


def flat_yaml(text: str) -> dict:
    """'key: value' lines with one level of nesting and typed scalars."""
    out: dict = {}
    parent = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip().strip("'\"")
        typed: object = value
        if re.fullmatch(r"[+-]?\d+", value):
            typed = int(value)
        elif re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", value):
            typed = float(value)
        elif value.lower() in ("true", "false"):
            typed = value.lower() == "true"
        elif value.lower() in ("null", "~"):
            typed = None
        if line[0] in " \t" and parent is not None:
            out[parent] = (out[parent] or {}) | {key: typed} if isinstance(out[parent], dict) else {key: typed}
        elif value == "":
            out[key], parent = {}, key
        else:
            out[key], parent = typed, None
    return out


def name_parts(c: Column) -> Column:
    """struct(doc, page) of an image name such as x_side3.png or x_p3.png; page is null for other names."""
    from kvern.functions.keys import doc_number

    return F.struct(doc_number(c).alias("doc"), F.regexp_extract(c, r"_(?:side|p)([0-9]+)\.[A-Za-z]+$", 1).try_cast("int").alias("page"))


# ----- further reports

def label_row_texts(preds: DataFrame, origin: str = "top") -> DataFrame:
    """pred_id and the label row of each prediction: document, page, x, y, width, height in points with two decimals, y from the given edge."""
    b = to_points(Box.of())
    y0 = b.y0 if origin == "top" else F.col("bilde_hoyde") / PX_PER_PT - b.y1
    two = lambda c, n: F.format_string("%.2f", c).alias(n)
    return preds.select("pred_id", F.col("doc_no").cast("string").alias("fil_revisjon_id"), F.col("side").cast("string").alias("sidetall"), two(b.x0, "x"), two(y0, "y"), two(b.width, "width"), two(b.height, "height"))


def not_wide(preds: DataFrame, most_pt: float) -> DataFrame:
    return preds.where(F.abs(F.col("x1") - F.col("x0")) / PX_PER_PT <= most_pt)


def not_doubtful(preds: DataFrame, least: float) -> DataFrame:
    """Without the detector's boxes below a confidence; a box without one stays."""
    return preds.where(~((F.col("kilde") == "yolo") & F.coalesce(F.col("conf") < least, F.lit(False))))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """measure, before, after, change of two one-row evaluations (stats.eval_overall)."""
    names = ("hit", "recall", "pred", "surplus", "overlap")
    both = before.select(*[F.col(n).cast("double").alias("b_" + n) for n in names]).join(after.select(*[F.col(n).cast("double").alias("a_" + n) for n in names]))
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col("b_" + n).alias("before"), F.col("a_" + n).alias("after"), F.round(F.col("a_" + n) - F.col("b_" + n), 6).alias("change")) for n in names])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def preflight(preds: DataFrame) -> DataFrame:
    """One row: n, n_features, n_window, below (boxes production's shape limits would have dropped), raw (whether there are any: else the rules ran before)."""
    short, long = F.col("short_side"), F.col("long_side")
    below = ((F.col("kilde") == "yolo") & (short < 7.0)) | ((F.col("kilde") == "paddle") & ((short < 7.0) | (long < 20.0) | (F.col("elongation") > 6.0)))
    r = preds.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("har_tokens", F.lit(0.0)) != 0).alias("n_features"), F.count("maks_luke").alias("n_window"), F.count_if(below).alias("below"))
    return r.withColumn("raw", F.col("below") > 0)


def labelled_pages(labels: DataFrame) -> DataFrame:
    """doc_no, pages: the pages a document has labels on."""
    return labels.groupBy("doc_no").agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("pages"))


def discarded_lookup(discarded: DataFrame, truth: DataFrame, lost: DataFrame) -> DataFrame:
    """label_id, state of discarded truth rows, looked up by document, page and corner rounded to one decimal: outside the scope, coverage lost, still covered."""
    key = lambda d: d.withColumns({"kx": F.round(F.col("x0") * 10, 0), "ky": F.round(F.col("y0") * 10, 0)})
    held = key(truth).join(lost.select("label_id").distinct().withColumn("lost", F.lit(True)), "label_id", "left").groupBy("doc_no", "side", "kx", "ky").agg(F.max_by(F.coalesce("lost", F.lit(False)), "label_id").alias("lost"))
    rows = key(discarded).join(held, ["doc_no", "side", "kx", "ky"], "left")
    return rows.select("label_id", F.when(F.col("lost").isNull(), "outside").when(F.col("lost"), "coverage lost").otherwise("still covered").alias("state"))


def drawn_pages(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """navn, side: pages with predictions, and pages with truth of the same documents under the first name of each."""
    first = preds.groupBy("doc_no").agg(F.min("navn").alias("navn"))
    return preds.select("navn", "side").union(truth.select("doc_no", "side").join(first, "doc_no").select("navn", "side")).distinct()


def truth_lists(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """pred_id, label_ids (joined by ;), dekkere: what each covering prediction covers, and the fewest coverers of any of it."""
    n = edges.groupBy("label_id").agg(F.count(F.lit(1)).alias("k"))
    held = edges.join(n, "label_id").groupBy("pred_id").agg(F.array_join(F.array_sort(F.collect_list("label_id")), ";").alias("label_ids"), F.min("k").alias("dekkere"))
    return classified.select("pred_id").join(held, "pred_id", "left").select("pred_id", F.coalesce("label_ids", F.lit("")).alias("label_ids"), F.coalesce("dekkere", F.lit(0)).alias("dekkere"))


def page_severity(kinds: DataFrame, lost: DataFrame, n: int) -> DataFrame:
    """doc_no, side, n_lost, critical, redundant, surplus of the n worst pages with removed boxes (stats.removal_kinds): most lost truth, critical, surplus first."""
    tally = lambda k: F.count_if(F.col("kind") == k).alias(k)
    pages = kinds.groupBy("doc_no", "side").agg(tally("critical"), tally("redundant"), tally("surplus"))
    gone = lost.groupBy("doc_no", "side").agg(F.count_distinct("label_id").alias("n_lost"))
    rows = pages.join(gone, ["doc_no", "side"], "left").na.fill(0, ["n_lost"])
    return rows.orderBy(F.desc("n_lost"), F.desc("critical"), F.desc("surplus"), "doc_no", "side").limit(n).select("doc_no", "side", "n_lost", "critical", "redundant", "surplus")


def uncovered_order(matches: DataFrame, truth: DataFrame, threshold: float = 0.32) -> DataFrame:
    """label_id, gruppe, nr: truth boxes that aren't well covered, below the threshold first, then by document, page, height; nr counts within the two groups' documents, so no task sorts all."""
    rows = matches.where("cov < 0.999999").join(truth.select("label_id", "y0", "x0"), "label_id").select("label_id", "doc_no", "side", "y0", "x0", F.when(F.col("cov") < threshold, "udekket").otherwise("daarlig_dekket").alias("gruppe"))
    per = rows.groupBy("gruppe", "doc_no").agg(F.count(F.lit(1)).alias("k")).withColumn("head", F.substring(F.lpad(F.col("doc_no").cast("string"), 20, "0"), 1, 17))
    order = F.when(F.col("gruppe") == "udekket", 0).otherwise(1)
    heads = per.groupBy("gruppe", "head").agg(F.sum("k").alias("k")).withColumn("o1", F.coalesce(F.sum("k").over(Window.orderBy(order, "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inner = per.withColumn("o2", F.coalesce(F.sum("k").over(Window.partitionBy("gruppe", "head").orderBy("doc_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = inner.join(heads, ["gruppe", "head"]).select("gruppe", "doc_no", (F.col("o1") + F.col("o2")).alias("before"))
    r = F.row_number().over(Window.partitionBy("gruppe", "doc_no").orderBy("side", "y0", "x0", "label_id"))
    return rows.withColumn("r", r).join(offsets, ["gruppe", "doc_no"]).select("label_id", "gruppe", (F.col("before") + F.col("r")).alias("nr"))


def sent_evaluation(matches: DataFrame, preds: DataFrame, sent: DataFrame) -> DataFrame:
    """One row over the sent documents: truth, hit, surplus (predictions that are no truth's hit)."""
    m, p = matches.join(sent, "doc_no", "left_semi"), preds.join(sent, "doc_no", "left_semi")
    used = m.where("hit").select("pred_id").distinct()
    return m.agg(F.count(F.lit(1)).alias("truth"), F.count_if("hit").alias("hit")).join(p.join(used, "pred_id", "left_anti").agg(F.count(F.lit(1)).alias("surplus")))


def live_summary(preds: DataFrame) -> DataFrame:
    """kilde (SUM for all), docs, boxes."""
    rows = preds.rollup("kilde").agg(F.count_distinct("doc_no").alias("docs"), F.count(F.lit(1)).alias("boxes")).where("boxes > 0")
    return rows.withColumn("kilde", F.coalesce("kilde", F.lit("SUM")))


def profile_shares(counts: DataFrame, n: int) -> DataFrame:
    """name, n, share of the n names with the largest sums over all workers (worker, name, n)."""
    per = counts.groupBy("name").agg(F.sum("n").alias("n"))
    return per.join(per.agg(F.sum("n").alias("all_n"))).where("all_n > 0").orderBy(F.desc("n"), "name").limit(n).select("name", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


def first_pages(docs: DataFrame, weight: str, budget: int) -> DataFrame:
    """doc_no, weight: documents in order of their number while those before weigh less than a budget; at most `budget` documents of weight 1 or more qualify, so the window is bounded."""
    some = docs.where(F.col(weight) > 0).orderBy("doc_no").limit(budget)
    before = F.coalesce(F.sum(weight).over(Window.orderBy("doc_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumn("before", before).where(F.col("before") < budget).select("doc_no", F.col(weight).alias("weight"))


def hard_union(*lists: DataFrame) -> DataFrame:
    """doc_no of any of the lists, once."""
    out = lists[0].select("doc_no")
    for other in lists[1:]:
        out = out.union(other.select("doc_no"))
    return out.distinct()
