"""Every query of the core by name: a function of (session, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions import geometry as g
from kvern.functions import numbers, text
from kvern.functions.keys import doc_number
from kvern.operators import labels as lab
from kvern.operators import layout, matching, measure, review, rules, sampling, stats, views
from kvern.plans.oracle import ORACLE
from kvern.session import materialize
from kvern.sources.files import label_lines
from kvern.sources.tables import table
from kvern.streaming import queue

__all__ = ["ORACLE", "QUERIES"]

#: Criteria and thresholds of the curve, the two criteria that are compared, the band that is reviewed.
THRESHOLDS = (0.15, 0.25, 0.32, 0.4, 0.5, 0.7, 0.9)
COMPARED = (("area", 0.32), ("iou", 0.2))
BAND = (0.25, 0.4)
PROFILE = ("SR_JOU", "AH_JOU", "KA_MOB", "KA_GRE", "TR_MAS", "SR_SKN", "JS_JSA", "FR_REG", "SR_UTS", "SE_SEK")


class Base:
    """The views of a folder, made as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def preds(self) -> DataFrame:
        return views.predictions(self.table("resultat"))

    @property
    def labels(self) -> DataFrame:
        return views.label_rows(self.table("labels"))

    @property
    def meta(self) -> DataFrame:
        return views.metadata_rows(self.table("metadata"))

    @property
    def manifest(self) -> DataFrame:
        return views.manifest_rows(self.table("manifest"))

    @property
    def judged(self) -> DataFrame:
        return views.judged(self.table("manifest"), self.table("verdicts"))

    def matched(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(predictions in scope, truth in scope, overlapping pairs).

        The truth is written once: it sets the scope (a document in scope has truth) and is matched.
        """
        truth = materialize(matching.truth_boxes(self.labels, views.page_sizes(self.table("resultat"))))
        inside = self.preds.join(truth.select("doc_no").distinct(), "doc_no", "left_semi")
        return inside, truth, matching.overlapping_pairs(inside, truth)

    def classified(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(classified predictions, edges, truth)."""
        inside, truth, pairs = self.matched()
        edges = matching.covers(pairs)
        return matching.classify(inside, edges), edges, truth

    def stored(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """classified() written once, for plans that read it several times."""
        inside, truth, pairs = self.matched()
        edges = materialize(matching.covers(pairs))
        return materialize(matching.classify(inside, edges)), edges, truth

    def best(self) -> tuple[DataFrame, DataFrame]:
        inside, truth, pairs = self.matched()
        return matching.best_matches(inside, truth, pairs), inside

    @property
    def pages(self) -> DataFrame:
        return views.page_sizes(self.table("resultat"))


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: f(Base(spark, folder))
    return f


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ----- matching and evaluation

@query
def match_summary(b):
    return matching.class_summary(b.classified()[0])


@query
def match_pairs_metrics(b):
    return r6(b.matched()[2].drop("pred_area", "truth_area", "overlap"), "cov_area", "cov_pred", "iou", "cov_short", "cov_long", "center_short")


@query
def truth_coverage(b):
    _, e, t = b.classified()
    return matching.coverage(t, e)


@query
def best_match_details(b):
    m = b.best()[0]
    return m.select("label_id", "doc_no", "side", "type", "pred_id", F.round("cov", 6).alias("cov"), "hit", F.when(F.col("hit"), F.col("kilde")).otherwise("").alias("kilde"))


@query
def eval_overall(b):
    return stats.eval_overall(*b.best())


@query
def eval_per_type(b):
    return stats.eval_per_type(b.best()[0])


@query
def eval_per_source(b):
    return stats.eval_per_source(*b.best())


@query
def eval_miss_pages(b):
    return stats.eval_miss_pages(b.best()[0])


@query
def run_stats(b):
    return stats.run_stats(*b.best())


@query
def worst_files(b):
    return stats.worst_files(b.best()[0])


@query
def threshold_curve(b):
    inside, _, pairs = b.matched()
    return matching.threshold_curve(inside, pairs, None, THRESHOLDS)


@query
def criterion_diff_truth(b):
    return matching.criterion_states(*b.matched(), *COMPARED)[0]


@query
def criterion_diff_class(b):
    return matching.criterion_states(*b.matched(), *COMPARED)[1]


# ----- rules and measurement

def production_configs() -> list[tuple[str, str | None, dict]]:
    return [(name, kilde, c) for name, (kilde, c) in rules.PRODUCTION.items()] + [("any " + k, k, c) for k, c in rules.ANY_CONFIDENCE.items()] + [("gated", None, rules.BEHIND_GATE)]


@query
def rule_verdicts(b):
    """config_id, pred_id of every box that a production rule removes."""
    configs = rules.config_frame(b.spark, [(n, "production", k, c) for n, k, c in production_configs()]).alias("c")
    on = F.col("c.kilde").isNull() | (F.col("c.kilde") == F.col("p.kilde"))
    pairs = b.preds.alias("p").join(configs, on)
    return pairs.where(rules.removed(lambda n: F.col("c." + n), lambda n: F.col("p." + n))).select("c.config_id", "p.pred_id")


@query
def rule_reasons_histogram(b):
    """reason (its first number as N), n over the boxes and the production rules."""
    configs = rules.config_frame(b.spark, [(n, "production", k, c) for n, k, c in production_configs()]).alias("c")
    on = F.col("c.kilde").isNull() | (F.col("c.kilde") == F.col("p.kilde"))
    why = b.preds.alias("p").join(configs, on).select(F.explode(rules.reasons(lambda n: F.col("c." + n), lambda n: F.col("p." + n))).alias("reason"))
    return why.select(text.first_number_masked(F.col("reason")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def measure_configs(b):
    return measure.measure(*b.stored(), production_configs())


@query
def sweep_grid(b):
    return measure.full_sweep(*b.stored())[0]


@query
def sweep_single(b):
    """The shared grids, and those of each source, without the combinations across sources."""
    c, e, t = b.stored()
    return measure.measure(c, e, t, measure.default_sweep(measure.sources(c))).select(*measure.SWEPT)


@query
def sweep_pareto(b):
    return measure.pareto(measure.full_sweep(*b.stored())[0]).select("config_id", "lost", "ov_rm", "net")


@query
def operating_point(b):
    return measure.operating_point(*b.stored()).select("config_id", "lost", "ov_rm", "n_rm", "net", "verdict")


@query
def leave_one_out(b):
    return measure.leave_one_out(measure.operating_point(*b.stored()))


@query
def holdout_measure(b):
    """The production rules measured on a document holdout, coverage counted anew inside it."""
    c, e, t = b.stored()
    docs = materialize(measure.holdout_documents(c.select("doc_no").distinct(), 0.3))
    return measure.measure(*measure.restricted(c, e, t, docs), production_configs()).select("config_id", "lost", "ov_rm", "n_rm", "covered_after", "recall_after", "net")


@query
def best_recommendation(b):
    """The config of the sweep with the largest net on the holdout, among the Pareto front of the other documents."""
    c, e, t = b.stored()
    docs = materialize(measure.holdout_documents(c.select("doc_no").distinct(), 0.3))
    rest = c.select("doc_no").distinct().join(docs, "doc_no", "left_anti")
    swept, chosen = measure.full_sweep(*measure.restricted(c, e, t, rest))
    front = measure.pareto(swept).select("config_id", F.col("net").alias("net_rest"))
    held = measure.full_sweep(*measure.restricted(c, e, t, docs), chosen)[0].select("config_id", "net", "lost", "ov_rm")
    return front.join(held, "config_id").orderBy(F.desc("net"), F.desc("net_rest"), "config_id").limit(1)


@query
def derived_limits(b):
    return measure.derived_limits(b.classified()[0])


@query
def shape_percentiles(b):
    return stats.shape_percentiles(b.classified()[0])


@query
def index_percentiles(b):
    return stats.index_percentiles(b.preds, "kilde", "areal_px")


@query
def confidence_sweep(b):
    return matching.confidence_points(*b.stored())


def _ranked(c, e, t) -> DataFrame:
    p = materialize(matching.confidence_points(c, e, t))
    best = p.orderBy("total", "miss", "conf").limit(1).withColumn("cut", F.lit("best"))
    return best.union(p.where("conf = 0.5").withColumn("cut", F.lit("standard")))


@query
def rank_models(b):
    """The confidence cut of least cost (then fewest misses, then the lowest), and the standard cut."""
    return _ranked(*b.stored())


@query
def rank_slices(b):
    """Misses at the cuts of rank_models on manual and moved truth, per decade and per code, and the worst of them."""
    c, e, t = b.stored()
    return matching.cut_slices(c, e, t, b.meta, materialize(_ranked(c, e, t)))


@query
def removal_kinds(b):
    c, e, _ = b.stored()
    gone = F.lit(False)
    for n, (kilde, config) in rules.PRODUCTION.items():
        gone = gone | ((F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    return stats.removal_kinds(c, e, gone)


@query
def page_triage(b):
    return stats.page_triage(b.classified()[0])


@query
def band_review(b):
    return stats.band_review(b.matched()[2], *BAND)


# ----- labels

def side_files(b) -> tuple[DataFrame, DataFrame]:
    """Derived stand-ins for the side files: ids whose md5 begins with 0 are retracted, BOM boxes of the manifest with nr divisible by 7 were noted as missing."""
    retracted = b.labels.where("md5(label_id) like '0%'").select("label_id")
    box = g.to_points(g.Box.of())
    noted = b.manifest.where("klasse = 'BOM' and nr % 7 = 0 and doc_no is not null and side is not null").select("doc_no", "side", *[c.alias(n) for n, c in zip(g.Box._fields, box)])
    return retracted, lab.added_rows(noted.where("x1 > x0 and y1 > y0"))


@query
def label_policy(b):
    return lab.policy(b.labels, *side_files(b)).select("label_id", "doc_no", "side", "origin", "outcome")


@query
def label_policy_tally(b):
    return lab.policy_tally(lab.policy(b.labels, *side_files(b)))


@query
def reclassify(b):
    return lab.reclassified(b.manifest, *side_files(b))


@query
def label_stats(b):
    return stats.label_outcomes(b.labels)


@query
def boxes_per_doc_distribution(b):
    return stats.boxes_per_document(b.labels)


@query
def page_share(b):
    return stats.page_share(b.labels)


@query
def status_crosstab(b):
    return stats.status_crosstab(b.labels)


@query
def position_density(b):
    return stats.position_density(b.labels)


@query
def label_sizes(b):
    return stats.size_summary(b.labels)


@query
def largest_labels(b):
    return stats.largest_labels(b.labels)


@query
def latest_version(b):
    """Labels of the highest version of their document: an aggregate and a join, as a window would sort a hot document in one task."""
    top = b.labels.groupBy("doc_no").agg(F.max("versjon").alias("m"))
    return b.labels.join(top, "doc_no").where("versjon = m").select("label_id", "doc_no", "versjon")


@query
def page_placement(b):
    """place, who, status, n: where labels lie on pages of known size."""
    placed = b.labels.join(b.pages, ["doc_no", "side"], "left")
    where = F.when(F.col("pw").isNull(), "no page").otherwise(g.placement(g.Box.of(), F.col("pw"), F.col("ph")))
    return placed.groupBy(where.alias("place"), F.when(F.col("ml"), "ml").otherwise("manual").alias("who"), "status").agg(F.count(F.lit(1)).alias("n"))


@query
def covering_label(b):
    """nr, label_id of manifest boxes that exactly one label of the page covers by a tenth or more."""
    px = g.to_points(g.Box.of())
    m = b.manifest.where("side is not null").select("nr", "doc_no", "side", *[c.alias(n) for n, c in zip(g.Box._fields, px)]).alias("m")
    on = (F.col("m.doc_no") == F.col("l.doc_no")) & (F.col("m.side") == F.col("l.side")) & (g.covered_share(g.Box.of("l."), g.Box.of("m.")) >= 0.1)
    return m.join(b.labels.alias("l"), on).groupBy("nr").agg(F.count(F.lit(1)).alias("n"), F.min("label_id").alias("label_id")).where("n = 1").select("nr", "label_id")


@query
def band_join(b):
    """nr, pred_id of manifest and result boxes of a page that agree within three pixels on every side."""
    m, p = b.manifest.alias("m"), b.preds.alias("p")
    return m.join(p, (F.col("m.doc_no") == F.col("p.doc_no")) & (F.col("m.side") == F.col("p.side")) & g.equal_within(g.Box.of("m."), g.Box.of("p."), 3.0)).select("nr", "pred_id")


@query
def label_files(b):
    """doc_no, side, content: the label file of each page with labels and a known size."""
    return label_lines(b.labels, b.pages)


@query
def turned_boxes(b):
    """label_id and the box turned by its page's parity, turned back, and whether that is the same box."""
    q = F.col("side") % 4
    box = g.Box.of()
    once = g.turned(box, F.lit(595.0), F.lit(842.0), q)
    back = g.unturned(once, F.lit(595.0), F.lit(842.0), q)
    return b.labels.select("label_id", *[F.round(c, 4).alias(n) for n, c in zip(g.Box._fields, once)], g.equal_within(back, box, 1e-6).alias("same"))


@query
def crop_plan(b):
    """nr, reason, the crop around each manifest box, the marker in it and how much it is shrunk."""
    s = g.crop_with_marker(g.Box.of(), F.lit(2480), F.lit(3508), 300.0, 60.0, -1.0, 60.0, widest=768)
    rows = b.manifest.where("x0 is not null").select("nr", s.alias("s"))
    corners = [F.round(f"s.{part}.{c}", 3).alias(p + c) for part, p in (("crop", "c"), ("marker", "m")) for c in g.Box._fields]
    return rows.select("nr", "s.reason", *corners, F.round("s.factor", 6).alias("factor"))


# ----- documents

@query
def code_density(b):
    c, e, t = b.stored()
    return stats.code_density(b.meta, c, matching.coverage(t, e))


@query
def electronic_density(b):
    _, e, t = b.classified()
    return stats.per_electronic(b.meta, matching.coverage(t, e))


@query
def documents_per_year(b):
    return stats.documents_per_year(b.meta, b.labels)


@query
def unreviewed_documents(b):
    return stats.unreviewed(b.meta, b.preds, b.labels)


@query
def profile_free_documents(b):
    return stats.without_profile(b.meta, b.preds, PROFILE)


@query
def code_descriptions(b):
    """code, description: the first description of each document-type code by document number."""
    rows = b.table("metadata").select(doc_number(F.col("fil_revisjon_id")).alias("doc_no"), F.explode(F.split("rettsstiftelsestyper", ",")).alias("part"))
    named = rows.select("doc_no", F.upper(F.trim(F.substring_index("part", " - ", 1))).alias("code"), F.trim(F.expr("substring(part, locate(' - ', part) + 3)")).alias("description")).where("code <> '' and locate(' - ', part) > 0 and doc_no is not null")
    return named.groupBy("code").agg(F.min_by("description", F.struct("doc_no", "description")).alias("description"))


@query
def split_overlap(b):
    """doc_no listed both in train and in an evaluation split."""
    s = b.table("splittliste").select(doc_number(F.col("fil")).alias("doc_no"), F.lower(F.trim("splitt")).alias("splitt")).where("doc_no is not null")
    return s.where("splitt = 'train'").select("doc_no").intersect(s.where("splitt in ('val', 'test')").select("doc_no"))


@query
def split_sizes(b):
    s = b.table("splittliste").select(doc_number(F.col("fil")).alias("doc_no"), F.lower(F.trim("splitt")).alias("splitt")).where("doc_no is not null")
    return s.groupBy("splitt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_no").alias("docs"))


# ----- verdicts

@query
def verdict_join(b):
    return b.judged.select("nr", "klasse", "gruppe", "kilde", "svar", "feil")


@query
def verdict_confusion(b):
    return stats.verdict_confusion(b.judged)


@query
def verdict_split(b):
    return stats.verdict_split(b.judged)


@query
def verdict_tally(b):
    return stats.verdict_tally(b.judged, b.manifest).drop("loss_upper")


@query
def verdict_bound(b):
    return stats.verdict_tally(b.judged, b.manifest).select("n_dek_nei", "loss_upper")


@query
def verdict_skew(b):
    return stats.skewed_sample(b.judged, b.manifest)


@query
def hard_documents(b):
    return stats.hard_documents(b.judged)


@query
def verdict_retry(b):
    return queue.retryable(b.table("manifest"), b.table("verdicts"))


@query
def verdict_subset(b):
    """nr of judged rows that meet all of several textual conditions."""
    return b.judged.where(text.condition(b.judged, "conf>=0.5") & text.condition(b.judged, "svar=nei") & text.condition(b.judged, "kilde!=paddle")).select("nr")


@query
def answer_parse(b):
    """verdict_id and what is read from the raw answer."""
    return text.with_answer(b.table("verdicts").select("verdict_id", "raatekst").distinct(), "raatekst").select("verdict_id", "answer.*")


@query
def answer_outcome(b):
    """svar, feil, n of the raw answers."""
    return text.with_answer(b.table("verdicts").select("verdict_id", "raatekst").distinct(), "raatekst").groupBy("answer.svar", "answer.feil").agg(F.count(F.lit(1)).alias("n"))


@query
def final_removal(b):
    """nr, kept of judged boxes: dropped only on nei without protection by a number or caption in any reading."""
    safe = numbers.protects(F.col("linjen"), F.col("ocr_linje"), F.col("ocr_tekst"))
    return b.judged.select("nr", (~((F.col("svar") == "nei") & ~safe & F.col("kilde").isin("yolo"))).alias("kept"))


# ----- samples

@query
def asymmetric_sample(b):
    return sampling.asymmetric_sample(b.classified()[0], 200)


@query
def hash_slice(b):
    return sampling.hash_slice(b.preds.select("navn").distinct(), F.col("navn"), 20)


@query
def stratified_holdout(b):
    return sampling.stratified_holdout(b.meta, "decade", 0.2)


@query
def quota_split(b):
    return sampling.quota_split(b.labels.groupBy("doc_no").agg(F.count_distinct("side").alias("pages")), "pages", 0.8, 0.1)


@query
def capped_groups(b):
    docs = b.labels.groupBy("doc_no").agg(F.count_distinct("side").alias("pages")).join(b.meta, "doc_no")
    return sampling.capped_per_group(docs, "decade", "pages", 25)


@query
def random_documents(b):
    return sampling.random_documents(b.preds, F.col("kilde") == "yolo", 25)


# ----- text

@query
def fnr_scan(b):
    """nr, start, stop, digest of every number found in the OCR text, by the fold in the JVM."""
    t = b.table("manifest").select("nr", "ocr_tekst").distinct().where("ocr_tekst is not null")
    hits = t.select("nr", F.explode(numbers.find_numbers(F.col("ocr_tekst"))).alias("h"))
    return hits.select("nr", F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.sha2(F.col("h.digits"), 256).alias("digest"))


@query
def orgnr_scan(b):
    """nr, n of nine-digit runs that are valid organisation numbers."""
    t = b.table("manifest").select("nr", "ocr_tekst").distinct().where("ocr_tekst is not null")
    found = F.filter(numbers.digit_runs(F.col("ocr_tekst")), lambda d: numbers.valid_orgnr(d) & d.rlike("^[89]"))
    return t.select("nr", F.size(found).alias("n")).where("n > 0")


@query
def digit_runs(b):
    t = b.table("manifest").select("nr", "ocr_tekst").distinct().where("ocr_tekst is not null")
    runs = numbers.digit_runs(F.col("ocr_tekst"))
    return t.select("nr", F.size(runs).alias("n"), F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).alias("longest"), numbers.longest_digits(F.col("ocr_tekst")).alias("plain"))


@query
def decimal_flags(b):
    t = b.table("manifest").select("nr", "ocr_tekst").distinct().where("ocr_tekst is not null")
    return t.select("nr", numbers.has_decimal(F.col("ocr_tekst")).alias("dec"), numbers.has_org_word(F.col("ocr_tekst")).alias("org"))


@query
def fnr_guard(b):
    """nr, protected: a caption and five digits in either reading."""
    t = b.manifest.select("nr", "ocr_tekst", "ocr_linje")
    both = lambda c: numbers.has_caption(F.coalesce(F.col(c), F.lit("")))
    return t.select("nr", (both("ocr_tekst") | both("ocr_linje")).alias("protected"))


@query
def secret_scan(b):
    """place, rad_id, line, column, kind of every strictly written identity number in the whole texts."""
    texts = b.table("documents").select(F.lit("text").alias("place"), F.col("doc_id").alias("rad_id"), F.col("text").alias("x")).union(b.table("manifest").select(F.lit("ocr_tekst"), "nr", "ocr_tekst").distinct())
    found = texts.where(F.col("x").rlike(numbers.STRICT)).select("place", "rad_id", F.explode(numbers.strict_numbers(F.col("x"))).alias("f"))
    return found.select("place", "rad_id", "f.line", "f.column", "f.kind")


@query
def content_keys(b):
    """doc_id and the 24-digit content key of its text."""
    return b.table("documents").where("text is not null").select("doc_id", text.content_key(F.col("text"), 24).alias("key"))


# ----- layout

def _tokens(b) -> DataFrame:
    t = b.table("manifest").where("nr is not null and ocr_tekst is not null").dropDuplicates(["nr"])
    return layout.text_tokens(t, "nr", "ocr_tekst")


def _page_tokens(b) -> DataFrame:
    """The OCR texts of the manifest's pages, each laid out on a grid from the corner of its own box on."""
    m = b.manifest.where("doc_no is not null and side is not null and x0 is not null and ocr_tekst is not null")
    return layout.placed_tokens(m.select(F.col("doc_no").alias("doc"), F.col("side").alias("page"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("nr").alias("no"), F.col("ocr_tekst").alias("content")))


def _page_boxes(b) -> DataFrame:
    """The detector's boxes on those pages: all boxes of resultat with a confidence, in the order of their ids."""
    pages = b.manifest.where("doc_no is not null and side is not null").select("doc_no", "side").distinct()
    p = b.preds.where("conf is not null").join(pages, ["doc_no", "side"], "left_semi")
    order = (F.row_number().over(Window.partitionBy("doc_no", "side").orderBy("pred_id")) - 1).cast("int")
    return p.select(F.col("doc_no").alias("doc"), F.col("side").alias("page"), order.alias("ord"), *[c.alias(n) for n, c in zip(g.Box._fields, g.Box.of().sorted())], "conf")


@query
def lines_from_tokens(b):
    return layout.lines_from_tokens(_tokens(b))


@query
def merge_boxes(b):
    return layout.merge_boxes(materialize(_page_tokens(b)), materialize(_page_boxes(b)))


@query
def box_features(b):
    return layout.box_features(materialize(_page_tokens(b)), materialize(_page_boxes(b)))


@query
def box_counts(b):
    """The counting features of detector boxes."""
    return layout.box_text_features(_page_tokens(b), _page_boxes(b))


@query
def marked_lines(b):
    m = layout.marked_lines(_tokens(b))
    return m.select("doc", "page", "line_no", "text", F.size("marks").alias("n"), F.size(F.filter("marks", lambda x: x["mod11"])).alias("valid"))


@query
def redaction_boxes(b):
    """The boxes over the numbers of the manifest's OCR texts, laid out on the grid."""
    return layout.redaction_boxes(layout.lines(_tokens(b)))


@query
def candidate_boxes(b):
    return layout.candidate_boxes(layout.lines(_tokens(b)))


@query
def ocr_context(b):
    """The text in and around every manifest box from the tokens of its page."""
    boxes = b.manifest.where("doc_no is not null and side is not null and x0 is not null").select(F.col("doc_no").alias("doc"), F.col("side").alias("page"), F.col("nr").alias("ord"), "x0", "y0", "x1", "y1")
    return layout.context(materialize(_page_tokens(b)), boxes, 1).select(F.col("ord").alias("nr"), "boks_tekst", "linje_tekst", "blokk_tekst")


@query
def guard_lines(b):
    boxes = b.manifest.where("doc_no is not null and side is not null and x0 is not null").select(F.col("doc_no").alias("doc"), F.col("side").alias("page"), F.col("nr").alias("ord"), "x0", "y0", "x1", "y1")
    return layout.guard_lines(_page_tokens(b), boxes).select(F.col("ord").alias("nr"), "linje")


@query
def detector_only(b):
    return review.detector_only(b.preds).select("pred_id", "kilde", "conf")


# ----- incremental

@query
def throughput_window(b):
    e = b.table("events").select((F.col("user_id") % 4).alias("worker"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint").alias("at"))
    per = e.groupBy("worker", "at").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy("worker").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return queue.throughput(per.withColumn("docs", total).select("worker", "at", "docs"), 3600).withColumnRenamed("at", "sec")


@query
def breaker_replay(b):
    e = b.table("events").select((F.col("user_id") % 16).alias("endpoint"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.col("event_id").alias("order"), (F.col("event_type") != "error").alias("ok"))
    return queue.breaker_replay(e)


@query
def events_tumbling(b):
    return queue.tumbling(b.table("events")).withColumn("window_start", F.unix_micros("window_start"))


@query
def events_session(b):
    return queue.sessions(b.table("events")).withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query
def events_first_seen(b):
    return queue.first_seen(b.table("events"), ["event_id"]).select("event_id", "event_type")


@query
def resume_documents(b):
    """Documents with predictions that the label table doesn't hold yet."""
    return queue.resumable(b.preds.select("doc_no").distinct(), b.labels)


# ----- review and smaller reports

@query
def profile_rules(b):
    """kilde, n, gone: what production discards, with the rule profiles of the documents."""
    d = review.discarded(b.preds, b.meta)
    return d.groupBy("kilde").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gone").cast("bigint")).alias("gone"))


_REC = (None, 0.80, 0.90, 0.95, 0.98)
#: The one-parameter sweeps: name, varied parameter, values (None: off), and the parameters beside it.
AXES = (
    ("min_elongation", "min_elongation", (1.1, 1.5, 1.7, 2.0, 2.5, 3.0, 3.5, 4.0), {}),
    ("max_height", "max_height", (25, 30, 35, 40, 45, 50, 60, 80, 100), {}),
    ("max_width", "max_width", (60, 80, 100, 120, 150, 200, 250), {}),
    ("conf_threshold", "conf_threshold", (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), {"min_elongation": 1.5, "max_height": 50, "max_width": 120}),
    ("min_area_px", "min_area_px", (500, 700, 965, 1200, 1600, 2200, 3000), {}),
    ("min_short_side", "min_short_side", (3, 4, 5, 6, 7, 8, 10), {}),
    ("min_long_side", "min_long_side", (10, 15, 20, 25, 30, 40, 50), {}),
    ("max_elongation", "max_elongation", (6, 8, 10, 12, 15, 20, 30, 50), {}),
    ("min_digits", "min_digits", (2, 3, 4, 5, 6, 8, 11), {}),
    ("max_letters", "max_letters", (0, 1, 2, 3), {}),
    ("min_digits_run", "min_digits_run", (6, 7, 8, 9, 10, 11), {}),
    ("min_digits + rec_veto", "rec_veto", _REC, {"min_digits": 2}),
    ("require_fnr_candidate + rec_veto", "rec_veto", _REC, {"require_fnr_candidate": 1}),
    ("reject_decimal + rec_veto", "rec_veto", _REC, {"reject_decimal": 1}),
    ("reject_decimal + ocr_conf_exempt", "ocr_conf_exempt", (None, 0.40, 0.45, 0.50, 0.60, 0.70), {"reject_decimal": 1, "rec_veto": 0.98}),
    ("reject_00_run + rec_veto", "rec_veto", _REC, {"reject_00_run": 1}),
    ("reject_orgnr + rec_veto", "rec_veto", _REC, {"reject_orgnr": 1}),
    ("reject_org_ord 1 + rec_veto", "rec_veto", _REC, {"reject_org_ord": 1}),
    ("reject_org_ord 2 + rec_veto", "rec_veto", _REC, {"reject_org_ord": 2}),
    ("require_fnr_candidate + line_veto", "line_veto", (None, 0.95, 0.98, 0.99, 0.995, 0.999, 0.9999), {"require_fnr_candidate": 1, "rec_veto": 0.98}),
    ("reject_run_6_10", "reject_run_6_10", (None, 8, 9, 10), {"rec_veto": 0.98, "line_veto": 0.99}),
    ("reject_run_6_10 9 + line_veto", "line_veto", (None, 0.98, 0.99, 0.995, 0.999, 0.9999), {"reject_run_6_10": 9, "rec_veto": 0.98}),
    ("without_text_conf", "without_text_conf", (None, 0.45, 0.50, 0.60, 0.70, 0.80), {}),
    ("max_gap", "max_gap", (1.5, 2, 3, 4, 6, 8, 12), {}),
    ("reject_decimal_gap", "reject_decimal_gap", (1,), {}),
    ("reject_decimal_gap + max_gap", "max_gap", (None, 1.5, 2, 3, 4, 6), {"reject_decimal_gap": 1}),
)


def axis_configs():
    return [(f"{name}={'off' if v is None else f'{v:g}'}", None, beside | ({} if v is None else {varied: v})) for name, varied, values, beside in AXES for v in values]


@query
def one_parameter_sweeps(b):
    return measure.measure(*b.stored(), axis_configs()).select("config_id", "lost", "ov_rm", "n_rm", "net")


@query
def lost_truth(b):
    c, e, _ = b.stored()
    gone = F.lit(False)
    for kilde, config in rules.ANY_CONFIDENCE.items():
        gone = gone | ((F.col("kilde") == kilde) & rules.removed(rules.literal(config), F.col))
    return review.lost_truth(c, e, gone)


@query
def coverage_review(b):
    return review.coverage_review(b.best()[0])


@query
def error_documents(b):
    return review.error_documents(b.labels)


@query
def manual_slice(b):
    return review.manual_slice(b.labels, b.meta)


@query
def thin_pages(b):
    return review.thin_pages(b.pages, b.labels, 3)


@query
def page_orientation(b):
    return review.page_orientation(b.pages)


@query
def numbered_boxes(b):
    return review.numbered(b.preds)


@query
def chosen_documents(b):
    return review.chosen_documents(b.meta, 1960, 1990, "^(HJ|PA)_")


@query
def rounded_join(b):
    return review.rounded_join(b.manifest, b.preds)


@query
def time_shares(b):
    return review.time_shares(b.table("verdicts"))


@query
def event_last_step(b):
    return review.last_step(b.table("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).distinct(), "user_id", "t")


@query
def listed_pages(b):
    """doc, page, n of the split lists' file names."""
    return b.table("splittliste").select(review.name_parts(F.col("fil")).alias("k")).groupBy("k.doc", "k.page").agg(F.count(F.lit(1)).alias("n"))


from kvern.plans import further, further_sql  # noqa: E402,F401  (they add to QUERIES and ORACLE)
