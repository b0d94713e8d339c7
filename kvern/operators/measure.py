"""What configs of rules cost and gain, truth by truth; sweeps, Pareto front, operating point.

All configs are judged in one pass: predictions carry bit masks of the configs that
remove them. A truth box is lost under a config when every box that covers it is
removed, which is the bitwise and of their masks, so the truth side is one aggregate
with map-side combine, whatever the number of configs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.operators.rules import ANY_CONFIDENCE, BEHIND_GATE, PRODUCTION, WORD, removed_rows, validated, with_masks
from kvern.operators.stats import linear_percentiles
from kvern.session import materialize

#: Removed boxes without truth that one lost truth box is worth.
COST = 5.0


def _sums_per_bit(df: DataFrame, n: int, values: list[str]) -> DataFrame:
    """config (bit index), and the sum of each value column over the rows that have the bit; masks are m0, m1, ..."""
    words = -(-n // WORD)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, len(values)))
        for f in frames:
            if not len(f):
                continue
            v = f[values].to_numpy(np.float64)
            for j in range(words):
                mask = f[f"m{j}"].to_numpy(np.int64)
                some = np.flatnonzero(mask)
                if not len(some):
                    continue
                width = min(WORD, n - j * WORD)
                bits = (mask[some, None] >> np.arange(width)[None]) & 1
                total[j * WORD : j * WORD + width] += bits.T.astype(np.float64) @ v[some]
        yield pd.DataFrame({"config": np.arange(n), **{c: total[:, i] for i, c in enumerate(values)}})

    parts = df.mapInPandas(run, "config int, " + ", ".join(f"{c} double" for c in values))
    return parts.groupBy("config").agg(*[F.sum(c).alias(c) for c in values])


def measure_masks(masked: DataFrame, edges: DataFrame, truth: DataFrame, n: int, cost: float = COST) -> DataFrame:
    """One row per config index of masked predictions (pred_id, klasse, area, m*): the full measurement.

    lost, lost_pct, ov_rm, ov_pct, red_rm, critical_rm, oversize_rm, n_rm, area_rm, ov_area_rm, covered_after,
    recall_after, prec_after, correct_after, ov_after, net, ov_per_lost (null where nothing is lost).
    """
    words = [f"m{j}" for j in range(-(-n // WORD))]
    flag = lambda c: c.cast("int")
    rows = masked.select(
        *words, F.lit(1).alias("n_rm"), flag(F.col("klasse") == "BOM").alias("ov_rm"), flag(F.col("klasse") == "SLURV").alias("oversize_rm"), flag(F.col("klasse") != "BOM").alias("covering_rm"),
        F.col("area").alias("area_rm"), F.when(F.col("klasse") == "BOM", F.col("area")).otherwise(0.0).alias("ov_area_rm"),
    )
    per_pred = _sums_per_bit(rows, n, ["n_rm", "ov_rm", "oversize_rm", "covering_rm", "area_rm", "ov_area_rm"])
    linked = edges.select("pred_id", "label_id").join(masked.select("pred_id", *words), "pred_id")
    lost = materialize(linked.groupBy("label_id").agg(*[F.bit_and(w).alias(w) for w in words]))
    per_truth = _sums_per_bit(lost.select(*words, F.lit(1).alias("lost")), n, ["lost"])
    # a removed covering box is critical where any truth it covers is lost
    any_lost = edges.select("pred_id", "label_id").join(lost, "label_id").groupBy("pred_id").agg(*[F.bit_or(w).alias("l" + w) for w in words])
    critical = any_lost.join(masked.select("pred_id", *words), "pred_id").select(*[F.col(w).bitwiseAND(F.col("l" + w)).alias(w) for w in words], F.lit(1).alias("critical_rm"))
    per_critical = _sums_per_bit(critical, n, ["critical_rm"])
    totals = (
        masked.agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("klasse") == "BOM").alias("n_bom"))
        .join(lost.agg(F.count(F.lit(1)).alias("covered_before")))
        .join(truth.agg(F.count(F.lit(1)).alias("n_truth")))
    )
    whole = lambda *names: [F.coalesce(F.col(c), F.lit(0.0)).cast("bigint").alias(c) for c in names]
    m = per_pred.join(per_truth, "config", "left").join(per_critical, "config", "left")
    m = m.select("config", *whole("n_rm", "ov_rm", "oversize_rm", "covering_rm", "lost", "critical_rm"), "area_rm", "ov_area_rm").join(totals)
    percent = lambda a, b: F.when(b > 0, a * 100.0 / b).otherwise(F.lit(0.0))
    c = F.col
    after, kept, right = c("covered_before") - c("lost"), c("n_pred") - c("n_rm"), c("n_pred") - c("n_bom") - c("covering_rm")
    return m.select(
        "config", "lost", F.round(percent(c("lost"), c("covered_before")), 4).alias("lost_pct"), "ov_rm", F.round(percent(c("ov_rm"), c("n_bom")), 4).alias("ov_pct"),
        (c("covering_rm") - c("critical_rm")).alias("red_rm"), "critical_rm", "oversize_rm", "n_rm", F.round("area_rm", 2).alias("area_rm"), F.round("ov_area_rm", 2).alias("ov_area_rm"),
        after.alias("covered_after"), F.round(percent(after, c("n_truth")), 4).alias("recall_after"), F.round(percent(right, kept), 4).alias("prec_after"),
        right.alias("correct_after"), (kept - right).alias("ov_after"), (c("ov_rm") - cost * c("lost")).alias("net"), F.round(F.when(c("lost") > 0, c("ov_rm") / c("lost")), 6).alias("ov_per_lost"),
    )


def measure(classified: DataFrame, edges: DataFrame, truth: DataFrame, configs: list[tuple[str, str | None, dict]], cost: float = COST) -> DataFrame:
    """The measurement of each (config_id, kilde or None, parameters)."""
    masked = materialize(with_masks(classified, [(k, c) for _, k, c in configs], ["pred_id", "klasse", "area"]))
    names = classified.sparkSession.createDataFrame([(i, n) for i, (n, _, _) in enumerate(configs)], "config int, config_id string")
    return measure_masks(masked, edges, truth, len(configs), cost).join(names, "config").drop("config")


def grid(prefix: str, axes: dict[str, list], kilde: str | None = None) -> list[tuple[str, str | None, dict]]:
    """Every combination of the axes' values, None for off, as (config_id, kilde, parameters)."""
    out = []
    for values in product(*axes.values()):
        on = {k: v for k, v in zip(axes, values) if v is not None}
        out.append((prefix + "".join(f" {k}={v:g}" for k, v in on.items()), kilde, on))
    return out


# The axes of the default sweep.
GEOMETRY_AXES = {"min_elongation": [None, 1.1, 1.2, 1.3, 1.4, 1.5, 1.7, 2.0, 2.5, 3.0], "max_height": [None, 40, 50, 60, 80], "max_width": [None, 80, 100, 120, 150], "conf_threshold": [None, 0.5]}
TEXT_AXES = {
    "digits": {"min_digits": [None, 2, 3, 5, 8, 11], "min_digits_run": [None, 6, 7, 9, 11], "reject_decimal": [None, 1], "rec_veto": [None, 0.80, 0.90, 0.95, 0.98]},
    "candidate": {"min_digits_run": [None, 6, 7, 9, 11], "require_fnr_candidate": [None, 1], "reject_decimal": [None, 1], "rec_veto": [None, 0.80, 0.90, 0.95, 0.98]},
    "line": {"require_fnr_candidate": [None, 1], "reject_run_6_10": [None, 9, 10], "line_veto": [None, 0.99, 0.995, 0.999, 0.9999], "ocr_conf_exempt": [None, 0.5, 0.6]},
    "orgnr": {"reject_00_run": [None, 1], "reject_orgnr": [None, 1], "reject_org_ord": [None, 1, 2], "rec_veto": [None, 0.90, 0.95, 0.98]},
    "org line": {"reject_00_run": [None, 1], "reject_orgnr": [None, 1], "line_veto": [None, 0.99, 0.999], "ocr_conf_exempt": [None, 0.5]},
    "few digits": {"min_digits": [None, 4, 5, 6], "rec_veto": [None, 0.95, 0.98], "line_veto": [None, 0.99], "ocr_conf_exempt": [None, 0.5, 0.6]},
    "exempt": {"reject_decimal": [None, 1], "rec_veto": [None, 0.90, 0.95, 0.98], "ocr_conf_exempt": [None, 0.40, 0.45, 0.50, 0.60, 0.70]},
}
WINDOW_AXES = {"reject_decimal_gap": [None, 1], "max_gap": [None, 1.5, 2, 3, 4, 6, 8]}
NOISE_AXES = {"min_short_side": [None, 4, 5, 6, 7], "min_long_side": [None, 15, 20, 25, 30], "max_elongation": [None, 6, 8, 10, 12, 15], "conf_threshold": [None, 0.5]}
#: The grids that are swept per source as well, and how many of each source's configs are combined across the sources.
SOURCE_AXES = {"geometry": GEOMETRY_AXES, "noise": NOISE_AXES}
CANDIDATES = 8
SWEPT = ("config_id", "lost", "ov_rm", "n_rm", "red_rm", "critical_rm", "net", "recall_after", "prec_after")


def sources(classified: DataFrame) -> dict[str, bool]:
    """kilde -> whether any of its boxes has a confidence, by name."""
    return {r["kilde"]: r["n"] > 0 for r in sorted(classified.groupBy("kilde").agg(F.count("conf").alias("n")).collect())}


def source_grid(family: str, kilde: str, has_conf: bool) -> list[tuple[str, str | None, dict]]:
    """The grid of a family for one source; without confidences that axis is off."""
    axes = SOURCE_AXES[family]
    return grid(f"{family} [{kilde}]", axes if has_conf else axes | {"conf_threshold": [None]}, kilde)


def _key(kilde: str | None, config: dict) -> tuple:
    return kilde, tuple(sorted(config.items()))


def default_sweep(found: dict[str, bool] | None = None) -> list[tuple[str, str | None, dict]]:
    """All configs of the default sweep, each parameter set once: the shared grids, and those of each source in `found`."""
    rows = grid("geometry", GEOMETRY_AXES)
    for name, axes in TEXT_AXES.items():
        rows += grid(name, axes)
    rows += grid("window", WINDOW_AXES, "paddle") + grid("noise", NOISE_AXES)
    for family in SOURCE_AXES:
        for kilde, has_conf in (found or {}).items():
            rows += source_grid(family, kilde, has_conf)
    once: dict = {}
    for name, kilde, config in rows:
        once.setdefault(_key(kilde, config), (name, kilde, config))
    return list(once.values())


Picks = dict[str, dict[str, list[tuple[str, str, dict]]]]


def full_sweep(classified: DataFrame, edges: DataFrame, truth: DataFrame, chosen: tuple[dict[str, bool], Picks] | None = None, cost: float = COST) -> tuple[DataFrame, tuple[dict[str, bool], Picks]]:
    """(SWEPT of every config of the sweep, what the data chose): the shared grids, the grids of each source, and per
    family every combination of the best CANDIDATES configs of each source (by net, then loss, then order of the grid).

    What was chosen on some documents can be given for others, so that the same configs are measured there.
    """
    found = chosen[0] if chosen else sources(classified)
    configs = default_sweep(found)
    single = materialize(measure(classified, edges, truth, configs, cost))
    out = single.select(*SWEPT)
    if len(found) < 2:
        return out, (found, {})
    ids = {_key(k, c): n for n, k, c in configs}
    measured = {r["config_id"]: r for r in single.select("config_id", "lost", "ov_rm", "n_rm", "net").collect()}
    picks = chosen[1] if chosen else {}
    if not chosen:
        for family in SOURCE_AXES:
            ranked = {k: sorted(source_grid(family, k, has), key=lambda r: (-measured[m := ids[_key(r[1], r[2])]]["net"], measured[m]["lost"])) for k, has in found.items()}
            picks[family] = {k: [(ids[_key(k, c)], n.removeprefix(f"{family} [{k}]").strip() or "off", c) for n, _, c in rows[:CANDIDATES]] for k, rows in ranked.items()}
    totals = (
        classified.agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("klasse") == "BOM").alias("n_bom"))
        .join(edges.agg(F.count_distinct("label_id").alias("covered_before"))).join(truth.agg(F.count(F.lit(1)).alias("n_truth"))).first()
    )
    for family, of_source in picks.items():
        out = out.union(_cross_sources(classified, edges, family, of_source, measured, totals, cost))
    return out, (found, picks)


def _cross_sources(classified: DataFrame, edges: DataFrame, family: str, picks: dict[str, list[tuple[str, str, dict]]], measured: dict, totals, cost: float) -> DataFrame:
    """SWEPT of every combination of one config per source.

    A box has one source, so what is removed adds up over the sources. A truth box is lost where, for every source that
    covers it, the chosen config removes all coverers of that source: a row per truth has the bitwise and of their masks
    in the slot of each source (all ones where the source doesn't cover it). Equal rows are counted before the
    combinations are formed, so no truth is multiplied by their number.
    """
    spark = classified.sparkSession
    widths = [len(p) for p in picks.values()]
    firsts = np.concatenate([[0], np.cumsum(widths)]).tolist()
    configs = [(k, c) for k, p in picks.items() for _, _, c in p]
    words = [f"m{j}" for j in range(-(-len(configs) // WORD))]
    slot = {k: set(range(firsts[s], firsts[s + 1])) for s, k in enumerate(picks)}

    def foreign(j: int):
        bits = range(j * WORD, min(len(configs), (j + 1) * WORD))
        column = F
        for k, own in slot.items():
            column = column.when(F.col("kilde") == k, F.lit(sum(1 << (i - j * WORD) for i in bits if i not in own)).cast("bigint"))
        return column.otherwise(F.lit(0).cast("bigint"))

    covering = classified.join(edges.select("pred_id").distinct(), "pred_id", "left_semi")
    slots = with_masks(covering, configs, ["pred_id", "kilde"]).select("pred_id", *[F.col(w).bitwiseOR(foreign(j)).alias(w) for j, w in enumerate(words)])
    links = edges.select("pred_id", "label_id")
    lost = materialize(links.join(slots, "pred_id").groupBy("label_id").agg(F.array(*[F.bit_and(w) for w in words]).alias("mask")))
    per_truth = lost.groupBy(F.array("mask").alias("masks")).agg(F.count(F.lit(1)).alias("n")).select("masks", "n", F.lit(True).alias("is_truth"))
    # a removed box is critical where any truth it covers is lost, and a truth is lost only with all that cover it
    per_pred = links.join(lost, "label_id").groupBy("pred_id").agg(F.sort_array(F.collect_set("mask")).alias("masks")).groupBy("masks").agg(F.count(F.lit(1)).alias("n")).select("masks", "n", F.lit(False).alias("is_truth"))
    n = int(np.prod(widths))

    def every(mask) -> np.ndarray | None:
        bits = np.concatenate([(np.int64(w) >> np.arange(WORD)) & 1 for w in mask]).astype(bool)
        out = np.ones(1, bool)
        for a, b in zip(firsts, firsts[1:]):
            if not bits[a:b].any():
                return None
            out = np.logical_and.outer(out, bits[a:b]).ravel()
        return out

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, n), np.int64)
        for f in frames:
            for masks, count, is_truth in zip(f["masks"], f["n"], f["is_truth"]):
                some = [v for v in map(every, masks) if v is not None]
                if some:
                    total[0 if is_truth else 1] += np.logical_or.reduce(some) * np.int64(count)
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"id": at, "lost": total[0, at], "critical_rm": total[1, at]})

    losses = per_truth.union(per_pred).mapInPandas(combine, "id bigint, lost bigint, critical_rm bigint").groupBy("id").agg(F.sum("lost").alias("lost"), F.sum("critical_rm").alias("critical_rm"))
    names = [np.array([f"{k} {label}" for _, label, _ in p], object) for k, p in picks.items()]
    sums = {c: [np.array([measured[i][c] for i, _, _ in p], np.int64) for p in picks.values()] for c in ("ov_rm", "n_rm")}

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.unravel_index(f["id"].to_numpy(), widths)
            ids = [f"cross {family} " + "; ".join(parts) for parts in zip(*[a[i] for a, i in zip(names, at)])]
            yield pd.DataFrame({"id": f["id"], "config_id": ids, **{c: sum(a[i] for a, i in zip(arrays, at)) for c, arrays in sums.items()}})

    rows = spark.range(n).mapInPandas(label, "id bigint, config_id string, ov_rm bigint, n_rm bigint").join(losses, "id", "left")
    c = F.col
    rows = rows.select("config_id", "ov_rm", "n_rm", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("lost", "critical_rm")], (c("n_rm") - c("ov_rm")).alias("covering_rm"))
    percent = lambda a, b: F.round(F.when(b > 0, a * 100.0 / b).otherwise(F.lit(0.0)), 4)
    kept, right = F.lit(totals["n_pred"]) - c("n_rm"), F.lit(totals["n_pred"] - totals["n_bom"]) - c("covering_rm")
    return rows.select(
        "config_id", "lost", "ov_rm", "n_rm", (c("covering_rm") - c("critical_rm")).alias("red_rm"), "critical_rm", (c("ov_rm") - cost * c("lost")).alias("net"),
        percent(F.lit(totals["covered_before"]) - c("lost"), F.lit(totals["n_truth"])).alias("recall_after"), percent(right, kept).alias("prec_after"),
    )


def pareto(measured: DataFrame) -> DataFrame:
    """The rows where more is removed than at any smaller loss; measured has one row per config, so one task sorts thousands."""
    before = Window.orderBy("lost", F.desc("ov_rm"), "config_id").rowsBetween(Window.unboundedPreceding, -1)
    return measured.withColumn("_best", F.coalesce(F.max("ov_rm").over(before), F.lit(-1))).where("ov_rm > _best").drop("_best")


SORT_KEYS = {"net": ["net desc"], "ov.rm": ["ov_rm desc"], "lost": ["lost"], "recall": ["recall_after desc"], "prec": ["prec_after desc"], "ov/lost": ["ov_per_lost desc nulls first"]}


def sort_by(measured: DataFrame, key: str) -> DataFrame:
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}; one of {', '.join(SORT_KEYS)}")
    return measured.orderBy(*[F.expr(k.split(" ")[0]).desc_nulls_first() if "nulls" in k else F.expr(k.split(" ")[0]).desc() if "desc" in k else F.expr(k) for k in SORT_KEYS[key]], "config_id")


def within(measured: DataFrame, max_lost: int | None = None, max_lost_pct: float | None = None, min_ov_lost: float | None = None) -> DataFrame:
    """Rows within the given bounds; a row without loss meets any ratio."""
    if max_lost is not None:
        measured = measured.where(F.col("lost") <= max_lost)
    if max_lost_pct is not None:
        measured = measured.where(F.col("lost_pct") <= max_lost_pct)
    if min_ov_lost is not None:
        measured = measured.where((F.col("lost") == 0) | (F.col("ov_per_lost") > min_ov_lost))
    return measured


def verdict(cost: float = COST):
    return F.when(F.col("n_rm") == 0, "no effect").when(F.col("lost") == 0, "free").when(F.col("ov_per_lost") >= cost, "pays").otherwise("DOES NOT PAY")


def production_groups(sources=("begge", "paddle", "yolo", "yolo_vertikal")) -> dict[str, list[tuple[str, dict]]]:
    """Today's rule groups: name -> [(kilde, parameters)], any of which removes a box."""
    groups = {name: [PRODUCTION[name]] for name in ("decimal", "decimal_low_tier", "line_evidence", "window")}
    groups["dimensions"] = [(s, ANY_CONFIDENCE.get(s, {"min_area_px": 965})) for s in sources] + [(s, BEHIND_GATE) for s in sources]
    return groups


def operating_point(classified: DataFrame, edges: DataFrame, truth: DataFrame, cost: float = COST) -> DataFrame:
    """Each rule group alone, all of them ('all'), and all but one ('without ...'), measured, with a verdict."""
    groups = production_groups()
    names = list(groups)
    sets = [(n, [n]) for n in names] + [("all", names)] + [(f"without {n}", [m for m in names if m != n]) for n in names]
    ready = {n: [(k, validated(c)) for k, c in g] for n, g in groups.items()}
    from kvern.operators.rules import INPUTS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = {name: f[name].to_numpy(np.float64, na_value=np.nan) for name in INPUTS}
            source = f["kilde"].to_numpy()
            hit = {n: np.logical_or.reduce([removed_rows(v, c) & (source == k) for k, c in g]) for n, g in ready.items()}
            mask = np.zeros(len(f), np.int64)
            for i, (_, members) in enumerate(sets):
                mask |= np.logical_or.reduce([hit[m] for m in members]).astype(np.int64) << np.int64(i)
            yield f[["pred_id", "klasse", "area"]].assign(m0=mask)

    masked = materialize(classified.select(*dict.fromkeys(["pred_id", "klasse", "area", "kilde", *INPUTS])).mapInPandas(run, "pred_id bigint, klasse string, area double, m0 bigint"))
    labels = classified.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(sets)], "config int, config_id string")
    return measure_masks(masked, edges, truth, len(sets), cost).join(labels, "config").drop("config").withColumn("verdict", verdict(cost))


def leave_one_out(point: DataFrame) -> DataFrame:
    """rule, d_ov_rm, d_lost, ratio (null where nothing is lost): what each rule adds on top of the others."""
    whole = point.where("config_id = 'all'").select(F.col("ov_rm").alias("a_ov"), F.col("lost").alias("a_lost"))
    rest = point.where("config_id like 'without %'").select(F.expr("substring(config_id, 9)").alias("rule"), "ov_rm", "lost")
    d = rest.join(whole).select("rule", (F.col("a_ov") - F.col("ov_rm")).alias("d_ov_rm"), (F.col("a_lost") - F.col("lost")).alias("d_lost"))
    return d.withColumn("ratio", F.round(F.when(F.col("d_lost") > 0, F.col("d_ov_rm") / F.col("d_lost")), 6))


def holdout_documents(docs: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """doc_no of the held-out documents: the first max(1, round(n * share)) in the order of md5(doc|seed).

    The cut is found without sorting all documents in one task: counts per leading byte of the hash locate the byte
    that holds the last document, and only that 256th part is ranked.
    """
    keyed = docs.select("doc_no").distinct().withColumn("key", F.md5(F.concat_ws("|", F.col("doc_no").cast("string"), F.lit(str(seed))))).withColumn("head", F.substring("key", 1, 2))
    counts = {r["head"]: r["n"] for r in keyed.groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    wanted, before, at = max(1, round(n * share)), 0, "zz"
    for head in sorted(counts):
        if before + counts[head] >= wanted:
            at = head
            break
        before += counts[head]
    last = keyed.where(F.col("head") == at).withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("key"))).where(F.col("r") <= wanted - before)
    return keyed.where(F.col("head") < at).select("doc_no").union(last.select("doc_no"))


def restricted(classified: DataFrame, edges: DataFrame, truth: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, edges and truth of the given documents; an edge never leaves its document."""
    p = classified.join(docs, "doc_no", "left_semi")
    return p, edges.join(p.select("pred_id"), "pred_id", "left_semi"), truth.join(docs, "doc_no", "left_semi")


def derived_limits(classified: DataFrame, pct: float = 1.0, least: int = 100) -> DataFrame:
    """kilde, n and the shape limits that the boxes with truth have had: percentiles pct and 100 - pct per source with enough of them."""
    some = classified.where("klasse <> 'BOM'")
    measures = ("elongation", "short_side", "long_side", "areal_px")
    long = some.select("kilde", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])).alias("m")).select("kilde", "m.*")
    low, high = pct / 100, 1 - pct / 100
    found = linear_percentiles(long, ["kilde", "measure"], (low, high)).where(F.col("n") >= least)
    one = lambda m, q, digits: F.round(F.max(F.when((F.col("measure") == m) & (F.col("q") == q), F.col("value"))), digits)
    cuts = [one(m, q, 2).alias(f"{side}_{m}") for m in measures[:3] for side, q in (("min", low), ("max", high))]
    return found.groupBy("kilde", "n").agg(*cuts, one("areal_px", low, 0).alias("min_area_px"))
