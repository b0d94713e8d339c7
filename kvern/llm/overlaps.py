"""Problem 3: same and near-same documents across splits.

A document's text is its distinct label boxes, one token each: page and grid cell of
x, y and width. The sorted array of all token suffixes puts suffixes with a common
first token beside each other; only neighbours from an evaluation split and from the
training split count, their common prefix is checked exactly, and the shared boxes are
merged into each document's coverage. Two things differ from a plain suffix array.
Boxes may be off by `tolerance` points and any 40 % of them may be missing, so that no
common prefix longer than one token is certain: the prefix asked for is one token. And
a token near a cell's edge has a second spelling, so the evaluation side writes each
box in every cell its counterparts can have. Heads that stand in very many documents
are kept out of the candidate search where a document can do without them: of n boxes
of which m must be matched, the n - m + 2 rarest must hold two matches.

Defined results: rows whose document, page or box can't be read, or with a zero size,
are left out; a document with fewer than `least` distinct boxes is near-same to none;
a listed document without labels can only be the same; a split that is not train, val
or test is left out. Documents with equal box sets are compared once per set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.keys import doc_number, number, positive_box, tag, whole_number
from kvern.session import materialize

TOLERANCE, LEAST, PART = 2.0, 5, 0.6
_SLACK = 1e-6


def split_members(splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc, splitt, uttrekk (null for pilot), distinct; splitt is train, val, test or pilot."""
    listed = splits.select(doc_number(F.col("fil")).alias("doc"), tag(F.col("splitt")).alias("splitt"), F.trim("uttrekk").alias("uttrekk")).where("doc is not null and splitt in ('train', 'val', 'test')")
    pilot = manifest.select(doc_number(F.col("fil")).alias("doc"), F.lit("pilot").alias("splitt"), F.lit(None).cast("string").alias("uttrekk")).where("doc is not null")
    return listed.union(pilot).distinct()


def boxes(labels: DataFrame) -> DataFrame:
    """doc, page, x, y, w, h: the distinct usable label boxes, sizes positive."""
    read = labels.select(
        doc_number(F.col("fil_revisjon_id")).alias("doc"),
        whole_number(F.col("sidetall")).alias("page"),
        positive_box(number(F.col("x")), number(F.col("y")), number(F.col("width")), number(F.col("height"))).alias("b"),
    )
    return read.select("doc", "page", "b.*").where("doc is not null and page is not null and x is not null and y is not null and w > 0 and h > 0").distinct()


def _cells(side: DataFrame, size: float, reach: float) -> DataFrame:
    """side with px, py, pw: one row per cell that a box within reach can fall into."""
    for name, c in (("px", "x"), ("py", "y"), ("pw", "w")):
        low, high = F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)
        side = side.withColumn(name, F.explode(F.sequence(low, high)) if reach else low)
    return side


def _near(a: str, b: str, tolerance: float):
    near = F.lit(True)
    for c in "xywh":
        near = near & (F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) <= tolerance + _SLACK)
    return near


def near_same(box_sets: DataFrame, evaluated: DataFrame, trained: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST, part: float = PART) -> DataFrame:
    """doc_e, doc_t, part_e, part_t of each near-same pair of an evaluated and a trained document (one column doc each)."""
    counted = box_sets.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"),
        # equal sets have equal keys: two independent sums of 64-bit hashes and the count
        F.sum(F.xxhash64("page", "x", "y", "w", "h").cast("decimal(38,0)")).alias("k1"),
        F.sum(F.xxhash64(F.lit(1), "page", "h", "w", "y", "x").cast("decimal(38,0)")).alias("k2"),
    ).where(F.col("n") >= least)
    roles = evaluated.select("doc", F.lit(True).alias("e")).union(trained.select("doc", F.lit(False).alias("e")))
    roles = roles.groupBy("doc").agg(F.max("e").alias("in_e"), F.max(~F.col("e")).alias("in_t"))
    used = counted.join(roles, "doc")
    first = used.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.max("in_e").alias("set_e"), F.max("in_t").alias("set_t"))
    members = materialize(used.join(first, ["n", "k1", "k2"]).select("doc", "rep", "n", "in_e", "in_t", "set_e", "set_t"))
    reps = members.where("doc = rep").select("doc", "n", "set_e", "set_t")
    tokens = materialize(_cells(box_sets.join(reps, "doc"), 2 * tolerance, 0.0))
    train = tokens.where("set_t").select("doc", "page", "x", "y", "w", "h", "px", "py", "pw")
    probes = _cells(tokens.where("set_e").select("doc", "n", "page", "x", "y", "w", "h"), 2 * tolerance, tolerance + _SLACK)
    heads = ["page", "px", "py", "pw"]

    # how many suffixes of the training side begin with each head; hot heads go last in every document
    hot = train.groupBy(heads).agg(F.count(F.lit(1)).alias("f"))
    box = ["doc", "n", "page", "x", "y", "w", "h"]
    weight = materialize(probes.join(hot, heads, "left").groupBy(box).agg(F.sum(F.coalesce("f", F.lit(0))).alias("f")))
    need = F.ceil(F.col("n") * part - 1e-9)
    # the rarest n - need + 2 boxes and those as rare as the last of them: ranks come from counts per rarity, so no task sorts the boxes of a document
    upto = F.sum("k").over(Window.partitionBy("doc").orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    ranks = weight.groupBy("doc", "n", "f").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", upto)
    last = ranks.where(F.col("upto") >= F.col("n") - need + 2).groupBy("doc").agg(F.min("f").alias("last"))
    rare = weight.where("f > 0").join(last, "doc", "left").where("f <= coalesce(last, f)").select(box)
    found = _cells(rare, 2 * tolerance, tolerance + _SLACK).alias("p").join(train.alias("t"), heads).where(_near("p", "t", tolerance) & (F.col("p.doc") != F.col("t.doc")))
    candidates = materialize(
        found.select(F.col("p.doc").alias("doc_e"), F.col("t.doc").alias("doc_t"), "p.page", "p.x", "p.y", "p.w", "p.h").distinct().groupBy("doc_e", "doc_t").count().where("count >= 2").select("doc_e", "doc_t")
    )

    # exact check of the candidates: every box of the evaluated document against the trained one's
    every = probes.withColumnRenamed("doc", "doc_e").join(candidates, "doc_e").alias("p")
    hits = every.join(train.alias("t"), (F.col("p.doc_t") == F.col("t.doc")) & (F.col("p.page") == F.col("t.page")) & (F.col("p.px") == F.col("t.px")) & (F.col("p.py") == F.col("t.py")) & (F.col("p.pw") == F.col("t.pw"))).where(_near("p", "t", tolerance))
    hits = hits.select("doc_e", "doc_t", F.struct("p.page", "p.x", "p.y", "p.w", "p.h").alias("be"), F.struct("t.x", "t.y", "t.w", "t.h", "t.page").alias("bt"))
    merged = hits.groupBy("doc_e", "doc_t").agg(F.count_distinct("be").alias("hit_e"), F.count_distinct("bt").alias("hit_t"))
    size = reps.select("doc", "n")
    shares = merged.join(size.select(F.col("doc").alias("doc_e"), F.col("n").alias("n_e")), "doc_e").join(size.select(F.col("doc").alias("doc_t"), F.col("n").alias("n_t")), "doc_t")
    linked = shares.select("doc_e", "doc_t", (F.col("hit_e") / F.col("n_e")).alias("part_e"), (F.col("hit_t") / F.col("n_t")).alias("part_t")).where((F.col("part_e") >= part - 1e-9) & (F.col("part_t") >= part - 1e-9))
    own = reps.where("set_e and set_t").select(F.col("doc").alias("doc_e"), F.col("doc").alias("doc_t"), F.lit(1.0).alias("part_e"), F.lit(1.0).alias("part_t"))
    return (
        linked.union(own)
        .join(members.where("in_e").select(F.col("rep").alias("doc_e"), F.col("doc").alias("e")), "doc_e")
        .join(members.where("in_t").select(F.col("rep").alias("doc_t"), F.col("doc").alias("t")), "doc_t")
        .where("e <> t")
        .select(F.col("e").alias("doc_e"), F.col("t").alias("doc_t"), "part_e", "part_t")
    )


def suffix_array_pairs(box_sets: DataFrame, evaluated: DataFrame, trained: DataFrame, prefix: int, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_e, doc_t, covered: the plain suffix array over the documents' box texts, kept for its figures.

    A text is the document's cells in reading order. The suffixes, cut to `prefix` tokens, are range-sorted; a run of
    suffixes with equal cuts has common prefixes of that length, and those of an evaluated and a trained document in one run
    share a span. covered counts the evaluated document's boxes in such spans, merged.
    """
    cells = _cells(box_sets, 2 * tolerance, 0.0).select("doc", "page", F.xxhash64("page", "px", "py", "pw").alias("token"), F.struct("page", "y", "x", "w", "h").alias("at"))
    order = Window.partitionBy("doc").orderBy("at")
    cut = F.array(*[F.lead("token", i).over(order) for i in range(prefix)])
    suffixes = cells.select("doc", F.row_number().over(order).alias("i"), cut.alias("cut")).where(~F.exists("cut", lambda t: t.isNull()))
    array = suffixes.repartitionByRange("cut").sortWithinPartitions("cut")
    e = array.join(evaluated, "doc", "left_semi").select("cut", F.col("doc").alias("doc_e"), "i")
    t = array.join(trained, "doc", "left_semi").select("cut", F.col("doc").alias("doc_t"))
    spans = e.join(t, "cut").where("doc_e <> doc_t").select("doc_e", "doc_t", F.explode(F.sequence(F.col("i"), F.col("i") + prefix - 1)).alias("i"))
    return spans.distinct().groupBy("doc_e", "doc_t").agg(F.count(F.lit(1)).alias("covered"))


def overlaps(labels: DataFrame, splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_e, doc_t, splitt, part_e, part_t: each document of an evaluation split with each train document that is the same or near-same."""
    member = materialize(split_members(splits, manifest).select("doc", "splitt").distinct())
    trained = member.where("splitt = 'train'").select("doc")
    evaluated = member.where("splitt <> 'train'")
    same = evaluated.join(trained, "doc", "left_semi").select(F.col("doc").alias("doc_e"), F.col("doc").alias("doc_t"), "splitt", F.lit(1.0).alias("part_e"), F.lit(1.0).alias("part_t"))
    near = near_same(materialize(boxes(labels)), evaluated.select("doc").distinct(), trained).join(evaluated.withColumnRenamed("doc", "doc_e"), "doc_e")
    return same.union(near.select("doc_e", "doc_t", "splitt", "part_e", "part_t"))


def found_pairs(labels: DataFrame, splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """dok_a <= dok_b, splitt of each overlap."""
    o = overlaps(labels, splits, manifest)
    return o.select(F.least("doc_e", "doc_t").alias("dok_a"), F.greatest("doc_e", "doc_t").alias("dok_b"), "splitt").distinct()


def overlap_report(labels: DataFrame, splits: DataFrame, manifest: DataFrame) -> DataFrame:
    """splitt, uttrekk, n_documents, n_same, n_near: the evaluation documents of each split and extract that overlap train."""
    found = overlaps(labels, splits, manifest).groupBy("doc_e", "splitt").agg(F.max(F.col("doc_e") == F.col("doc_t")).alias("same"), F.max(F.col("doc_e") != F.col("doc_t")).alias("near"))
    where = split_members(splits, manifest).where("splitt <> 'train'").withColumnRenamed("doc", "doc_e")
    return where.join(found, ["doc_e", "splitt"], "left").groupBy("splitt", "uttrekk").agg(
        F.count_distinct("doc_e").alias("n_documents"), F.count_distinct(F.when(F.col("same"), F.col("doc_e"))).alias("n_same"), F.count_distinct(F.when(F.col("near"), F.col("doc_e"))).alias("n_near")
    )
