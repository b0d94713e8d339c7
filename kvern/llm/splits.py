"""Problem 2: splits that keep related records together.

Documents are joined into components by shared identity and by predecessor.
Components carry a label vector (rows per type). Grouped iterative stratification then
takes the label of which least is outstanding, and places the components that hold it,
those with most of it first, each into the split that needs that label most among those
with room. Within a label's turn a decision depends only on how much of the label and how
many rows a component has, so equal components are placed together: the driver sees how
many components there are of each (label rows, rows), decides how many of them each
split gets, and the executors deal them out in hash order. The result is that of
placing one component after the other, at any data size; there is no lump and no cap.
The pairs (label rows, rows) are few: their rows sum to at most the table, so n rows have
at most about n ** (2 / 3) of them, and in practice some thousands.

Defined results: a row whose document can't be read is its own component by its
id (rows without id as well: one component); a null or blank type is the
label "(none)". Repeated rows stay, all in one split. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.keys import doc_number, upper_tag
from kvern.llm.components import components
from kvern.session import join_hot, materialize

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def document_groups(metadata: DataFrame) -> DataFrame:
    """node, root of every metadata document that is related to another one.

    A complete identity has all three parts, dokumentnummer above 0. Each holder of
    an identity is linked to the smallest holder, so a hot identity has as many
    links as rows.
    """
    m = metadata.select(
        doc_number(F.col("fil_revisjon_id")).alias("doc"),
        doc_number(F.col("forrige_revisjon_id")).alias("previous"),
        F.col("embetenummer").alias("e"),
        F.col("dokument_aar").alias("y"),
        F.when(F.col("dokumentnummer") != 0, F.col("dokumentnummer")).alias("n"),
    ).where("doc is not null")
    whole = m.where("e is not null and y is not null and n is not null").select("e", "y", "n", "doc").distinct()
    first = whole.groupBy("e", "y", "n").agg(F.min("doc").alias("low"))
    same = whole.join(first, ["e", "y", "n"]).select(F.col("doc").alias("a"), F.col("low").alias("b"))
    present = m.select(F.col("doc").alias("previous")).distinct()
    named = m.where("previous is not null").select("doc", "previous").distinct().join(present, "previous", "left_semi").select(F.col("doc").alias("a"), F.col("previous").alias("b"))
    return components(same.union(named))


def related_documents(labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """dok_nr, gruppe of each document of labels whose group has two or more documents in metadata."""
    seen = labels.select(doc_number(F.col("fil_revisjon_id")).alias("node")).where("node is not null").distinct()
    return document_groups(metadata).join(seen, "node", "left_semi").select(F.col("node").alias("dok_nr"), F.col("root").alias("gruppe"))


def _dealt(value: list[int], step: int, most: list[int], count: int) -> list[int]:
    """How many of the `count` largest numbers of the sequences value[s], value[s] - step, ... (at most most[s] of each) lie clearly in sequence s.

    Numbers at the last level are left out where they would exceed count, so the sum may be short by less than the number of sequences.
    """
    above = lambda level: [min(m, (v - level) // step + 1) if v >= level else 0 for v, m in zip(value, most)]
    low, high = min(value) - step * count, max(value) + 1
    while low < high:
        middle = (low + high) // 2
        if sum(above(middle)) <= count:
            high = middle
        else:
            low = middle + 1
    return above(high)


class Plan:
    """What each split still needs of each label, and its room, in whole units of 1 / scale rows."""

    def __init__(self, totals: dict[str, int], proportions: dict[str, float]):
        self.splits = list(proportions)
        parts = [Fraction(repr(p)) for p in proportions.values()]
        parts = [p / sum(parts) for p in parts]
        self.scale = lcm(*(p.denominator for p in parts))
        share = [int(p * self.scale) for p in parts]
        self.need = {label: [n * s for s in share] for label, n in totals.items()}
        self.room = [sum(totals.values()) * s for s in share]
        self.left = dict(totals)

    def next_label(self) -> str | None:
        """The label of which least is outstanding, the first by name on ties."""
        waiting = [(n, label) for label, n in self.left.items() if n > 0]
        return min(waiting)[1] if waiting else None

    def place(self, label: str, classes: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
        """(part, size, units per split) for classes (part, size, number of units), taken in order; need and room of the label move along."""
        need, room, k = self.need[label], self.room, len(self.splits)
        out = []
        for part, size, count in classes:
            given = [0] * k
            while count:
                large, small = size * self.scale, part * self.scale
                fits = [s for s in range(k) if room[s] >= large]
                if fits:
                    taken = _dealt([need[s] for s in fits], small, [room[s] // large for s in fits], count)
                    one = max(fits, key=lambda s: (need[s], room[s]))
                else:
                    fits = list(range(k))
                    taken = _dealt(room, large, [count] * k, count)
                    one = max(fits, key=lambda s: room[s])
                for s, n in zip(fits, taken) if any(taken) else [(one, 1)]:
                    given[s] += n
                    need[s] -= n * small
                    room[s] -= n * large
                    count -= n
            out.append((part, size, given))
        return out

    def placed(self, label: str, sums: Iterable[tuple[str, str, int]]) -> None:
        """Book the other labels of the units placed in a label's turn: (split, label, rows)."""
        for split, other, n in sums:
            self.left[other] -= n
            if other != label:
                self.need[other][self.splits.index(split)] -= n * self.scale
        self.left[label] = 0


def _deal(candidates: DataFrame, given: list[tuple[int, int, list[int]]], splits: list[str]) -> DataFrame:
    """candidates (gruppe, vector, part, size, h) with splitt: in each class, in hash order, the first units to the first split, and so on.

    Ranks run within 256 hash ranges of a class and get their offsets from the ranges' counts, so no task ranks a class as a whole.
    """
    spark = candidates.sparkSession
    keyed = candidates.withColumn("head", F.pmod("h", F.lit(256)))
    counts = keyed.groupBy("part", "size", "head").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("part", "size").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).drop("k")
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("part", "size", "head").orderBy("h", "gruppe"))).join(offsets, ["part", "size", "head"])
    upto = spark.createDataFrame([(p, z, [sum(g[: i + 1]) for i in range(len(g))]) for p, z, g in given], "part bigint, size bigint, upto array<bigint>")
    place = F.element_at(F.array(*map(F.lit, splits)), (F.size(F.filter("upto", lambda u: u < F.col("before") + F.col("r"))) + 1).cast("int"))
    return ranked.join(upto, ["part", "size"]).select("gruppe", "vector", place.alias("splitt"))


def stratified(groups: DataFrame, proportions: dict[str, float], seed: int = 7) -> DataFrame:
    """gruppe, splitt; groups: gruppe, vector (map of label to rows), size (all its rows)."""
    totals = {r["label"]: r["n"] for r in groups.select(F.explode("vector").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(totals, proportions)
    done: list[str] = []
    out = groups.select("gruppe", F.lit(None).cast("string").alias("splitt")).limit(0)
    while (label := plan.next_label()) is not None:
        turn = groups.where(F.map_contains_key("vector", F.lit(label)))
        if done:
            turn = turn.where(~F.exists(F.map_keys("vector"), lambda k: k.isin(done)))
        turn = turn.select("gruppe", "vector", F.element_at("vector", F.lit(label)).alias("part"), "size", F.xxhash64("gruppe", F.lit(seed)).alias("h"))
        classes = turn.groupBy("part", "size").agg(F.count(F.lit(1)).alias("k")).collect()
        given = plan.place(label, sorted(((r["part"], r["size"], r["k"]) for r in classes), key=lambda c: (-c[0], -c[1])))
        dealt = materialize(_deal(turn, given, plan.splits))
        sums = dealt.select("splitt", F.explode("vector").alias("label", "n")).groupBy("splitt", "label").agg(F.sum("n").alias("n")).collect()
        plan.placed(label, [(r["splitt"], r["label"], r["n"]) for r in sums])
        out = out.union(dealt.select("gruppe", "splitt"))
        done.append(label)
    return out


def grouped_splits(labels: DataFrame, metadata: DataFrame, proportions: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """Every labels row with its split: id, fil_revisjon_id, sidetall, versjon, lastet, dok_nr, gruppe, splitt.

    gruppe is the smallest document number of the group, or id:<id> for a row without
    a readable document.
    """
    roots = document_groups(metadata).select(F.col("node").cast("string").alias("key"), F.col("root").cast("string").alias("root"))
    rows = labels.select(
        "id", "fil_revisjon_id", "sidetall", "versjon", "lastet",
        doc_number(F.col("fil_revisjon_id")).alias("dok_nr"),
        F.coalesce(upper_tag(F.col("type")), F.lit("(none)")).alias("label"),
    ).withColumn("key", F.coalesce(F.col("dok_nr").cast("string"), F.concat(F.lit("id:"), F.coalesce("id", F.lit("")))))
    # per document and label first: a hot document is a handful of rows from here on
    per_doc = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    vectors = materialize(per_doc.join(roots, "key", "left").withColumn("gruppe", F.coalesce("root", "key")).drop("root"))
    sums = vectors.groupBy("gruppe", "label").agg(F.sum("n").alias("n"))
    groups = materialize(sums.groupBy("gruppe").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector"), F.sum("n").alias("size")))
    split_of = stratified(groups, proportions or PROPORTIONS, seed)
    per_key = vectors.groupBy("key", "gruppe").agg(F.sum("n").alias("n")).join(split_of, "gruppe")
    placed = join_hot(rows.drop("label"), materialize(per_key), "key", "n")
    return placed.select("id", "fil_revisjon_id", "sidetall", "versjon", "lastet", "dok_nr", "gruppe", "splitt")


def split_report(splits: DataFrame) -> DataFrame:
    """splitt, n_rows, n_groups, share of all rows."""
    per = splits.groupBy("splitt", "gruppe").agg(F.count(F.lit(1)).alias("n")).groupBy("splitt").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    return per.crossJoin(per.agg(F.sum("n_rows").alias("all_rows"))).select("splitt", "n_rows", "n_groups", (F.col("n_rows") / F.col("all_rows")).alias("share"))
