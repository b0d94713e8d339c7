"""The 28-parameter rule engine over box features, as Columns and as vectorised bit masks.

A config is a set of parameters; an unset one is off. The verdict of a box: text rules
first, in a fixed order with its own exemptions, then the smallest area, then the
confidence gate, then the shape limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape parameters: name -> (measure, whether a smaller value is rejected, unit in texts).
SHAPE = {
    "min_elongation": ("elongation", True, ""), "max_elongation": ("elongation", False, ""),
    "max_height": ("h", False, "pt"), "min_height": ("h", True, "pt"), "max_width": ("w", False, "pt"), "min_width": ("w", True, "pt"),
    "min_short_side": ("short_side", True, "pt"), "max_short_side": ("short_side", False, "pt"),
    "min_long_side": ("long_side", True, "pt"), "max_long_side": ("long_side", False, "pt"), "max_area": ("area", False, "pt2"),
}
GATES = ("min_area_px", "conf_threshold")
TEXT = (
    "min_digits", "max_letters", "min_digits_run", "require_fnr_candidate", "reject_decimal", "rec_veto", "ocr_conf_exempt", "reject_00_run",
    "reject_orgnr", "reject_org_ord", "line_veto", "reject_run_6_10", "without_text_conf", "max_gap", "reject_decimal_gap",
)
PARAMETERS = (*SHAPE, *GATES, *TEXT)

# The production rules.
PRODUCTION = {
    "decimal": ("yolo", {"reject_decimal": 1, "rec_veto": 0.98, "ocr_conf_exempt": 0.6}),
    "decimal_low_tier": ("yolo", {"reject_decimal": 1, "rec_veto": 0.95, "ocr_conf_exempt": 0.4}),
    "line_evidence": ("yolo", {"reject_run_6_10": 8, "reject_orgnr": 1, "line_veto": 0.99, "ocr_conf_exempt": 0.5}),
    "window": ("paddle", {"max_gap": 6.5, "reject_decimal_gap": 1}),
    "coordinates": ("yolo", {"require_fnr_candidate": 1, "reject_decimal": 1}),
    "sectioning_yolo": ("yolo", {"max_short_side": 40.0, "max_long_side": 80.0, "min_digits": 6, "rec_veto": 0.98, "ocr_conf_exempt": 0.5}),
    "sectioning_paddle": ("paddle", {"min_elongation": 3.0, "max_short_side": 40.0, "max_long_side": 80.0}),
}
# Shape limits of production, per source; limits on any confidence, and those behind the confidence gate.
ANY_CONFIDENCE = {
    "yolo": {"min_area_px": 965, "min_short_side": 7.0, "min_long_side": 20.0, "max_elongation": 6.0},
    "paddle": {"min_area_px": 965, "min_short_side": 7.0, "min_long_side": 20.0, "max_elongation": 6.0},
    "yolo_vertikal": {"min_area_px": 965, "min_long_side": 30.0},
    "begge": {"min_area_px": 965},
}
BEHIND_GATE = {"min_elongation": 1.44, "max_elongation": 9.0, "min_short_side": 6.0, "conf_threshold": 0.5}


def validated(config: dict[str, float | None]) -> dict[str, float]:
    """The set parameters of a config; an unknown one is an error."""
    for name in config:
        if name not in PARAMETERS:
            raise TypeError(f"unknown filter parameter {name!r}; one of {', '.join(PARAMETERS)}")
    return {k: float(v) for k, v in config.items() if v is not None}


def config_frame(spark, rows: list[tuple[str, str, str | None, dict]]) -> DataFrame:
    """configs: config_id, rule_group, kilde (null: all), and the 28 parameters as nullable doubles."""
    schema = "config_id string, rule_group string, kilde string, " + ", ".join(f"{p} double" for p in PARAMETERS)
    return spark.createDataFrame([(i, g, k, *(validated(c).get(p) for p in PARAMETERS)) for i, g, k, c in rows], schema)


Get = Callable[[str], Column]


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _on(c: Column) -> Column:
    """Truth of a flag: neither null nor 0."""
    return F.coalesce(c, F.lit(0.0)) != 0


def _text_steps(c: Get, p: Get) -> list[tuple[Column, Column | None]]:
    """(condition, reason) in order; a null reason keeps the box and ends the text rules."""
    number = lambda x: F.format_string("%.0f", x)
    zero = lambda n: F.coalesce(p(n), F.lit(0.0))
    keep = None
    longest = F.when(c("reject_run_6_10") == 1, F.lit(10.0)).otherwise(c("reject_run_6_10"))
    return [
        (_no(c("without_text_conf").isNotNull() & (p("har_tokens") == 0) & (p("conf").isNull() | (p("conf") < c("without_text_conf")))), F.lit("no text and low confidence")),
        (_on(c("reject_decimal_gap")) & _on(p("har_desimal_luke")), F.lit("decimal in a gap of the window")),
        (_no(p("maks_luke") >= c("max_gap")), F.lit("wide gap in the window")),
        (~_on(p("har_tokens")), keep),
        (_no(p("conf") >= c("ocr_conf_exempt")), keep),
        (c("rec_veto").isNotNull() & (p("rec_min").isNull() | (p("rec_min") < c("rec_veto"))), keep),
        (c("line_veto").isNotNull() & (p("rec_min_linje").isNull() | (p("rec_min_linje") < c("line_veto"))), keep),
        (_no(zero("n_siffer") < c("min_digits")), F.concat(F.lit("digits "), number(zero("n_siffer")))),
        (_no(zero("n_bokstaver") > c("max_letters")), F.concat(F.lit("letters "), number(zero("n_bokstaver")))),
        (_no(zero("siffer_run") < c("min_digits_run")), F.concat(F.lit("digit run "), number(zero("siffer_run")))),
        (_on(c("require_fnr_candidate")) & ~_on(p("har_fnr_kandidat")), F.lit("no candidate on the line")),
        (_on(c("reject_decimal")) & _on(p("har_desimal_naer")), F.lit("decimal inside the number")),
        (_on(c("reject_00_run")) & _on(p("har_00_run")), F.lit("run starts with 00")),
        (_on(c("reject_orgnr")) & _on(p("har_orgnr")), F.lit("organisation number in the box")),
        (_on(c("reject_org_ord")) & _on(p("har_org_ord")) & ((c("reject_org_ord") < 2) | ~_on(p("har_fnr_kandidat"))), F.lit("company word near the box")),
        (_on(c("reject_run_6_10")) & _no(p("lang_run").between(F.lit(6.0), longest)), F.concat(F.lit("run of "), number(p("lang_run")))),
    ]


def _gated(c: Get, p: Get) -> Column:
    return _no(p("conf") >= c("conf_threshold"))


def _beyond(c: Get, p: Get, name: str) -> Column:
    measure, below, _ = SHAPE[name]
    return _no(p(measure) < c(name)) if below else _no(p(measure) > c(name))


def removed(c: Get, p: Get) -> Column:
    """Whether config c removes box p, both read by parameter or measure name."""
    text: object = F
    for cond, reason in _text_steps(c, p):
        text = text.when(cond, F.lit(reason is not None))
    shape = F.lit(False)
    for name in SHAPE:
        shape = shape | _beyond(c, p, name)
    return text.otherwise(F.lit(False)) | _no(p("areal_px") < c("min_area_px")) | (~_gated(c, p) & shape)


def reasons(c: Get, p: Get) -> Column:
    """Array of why config c removes box p: one text reason, or the area, or every shape limit that is broken."""
    none = F.expr("cast(null as string)")
    text: object = F
    for cond, reason in _text_steps(c, p):
        text = text.when(cond, none if reason is None else reason)
    said = text.otherwise(none)
    small = F.when(_no(p("areal_px") < c("min_area_px")), F.concat(F.lit("area "), F.format_string("%.0f", p("areal_px")), F.lit("px2")))
    shapes = F.filter(F.array(*[F.when(_beyond(c, p, n), F.concat(F.lit(f"{n.replace('_', ' ')} broken by "), F.format_string("%.1f", p(SHAPE[n][0])))) for n in SHAPE]), lambda x: x.isNotNull())
    nothing = F.expr("cast(array() as array<string>)")
    return F.when(said.isNotNull(), F.array(said)).when(small.isNotNull(), F.array(small)).when(_gated(c, p), nothing).otherwise(shapes)


def literal(config: dict) -> Get:
    """A config of literals: unset parameters fold away in the plan."""
    values = validated(config)
    return lambda name: F.lit(values[name]) if name in values else F.lit(None).cast("double")


# ----- the same verdict for many configs at once

WORD = 62
_MEASURES = ("elongation", "h", "w", "short_side", "long_side", "area", "areal_px", "conf")
TEXT_FEATURES = ("har_tokens", "n_siffer", "n_bokstaver", "rec_min", "rec_min_linje", "siffer_run", "har_fnr_kandidat", "har_desimal_naer", "har_00_run", "har_orgnr", "har_org_ord", "lang_run", "maks_luke", "har_desimal_luke")
INPUTS = (*_MEASURES, *TEXT_FEATURES)


def removed_rows(v: dict[str, np.ndarray], c: dict[str, float]) -> np.ndarray:
    """The verdict of one config over arrays of features, NaN for null; same rules as `removed`."""
    n = len(v["conf"])
    on = lambda name: np.nan_to_num(v[name]) != 0
    zero = lambda name: np.nan_to_num(v[name])
    with np.errstate(invalid="ignore"):
        out = np.zeros(n, bool)
        if any(name in c for name in TEXT):
            tokens = v["har_tokens"]
            if "without_text_conf" in c:
                out |= (tokens == 0) & ~(v["conf"] >= c["without_text_conf"])
            if c.get("reject_decimal_gap"):
                out |= on("har_desimal_luke")
            if "max_gap" in c:
                out |= v["maks_luke"] >= c["max_gap"]
            live = on("har_tokens")
            if "ocr_conf_exempt" in c:
                live &= ~(v["conf"] >= c["ocr_conf_exempt"])
            if "rec_veto" in c:
                live &= v["rec_min"] >= c["rec_veto"]
            if "line_veto" in c:
                live &= v["rec_min_linje"] >= c["line_veto"]
            bad = np.zeros(n, bool)
            if "min_digits" in c:
                bad |= zero("n_siffer") < c["min_digits"]
            if "max_letters" in c:
                bad |= zero("n_bokstaver") > c["max_letters"]
            if "min_digits_run" in c:
                bad |= zero("siffer_run") < c["min_digits_run"]
            if c.get("require_fnr_candidate"):
                bad |= ~on("har_fnr_kandidat")
            for rule, feature in (("reject_decimal", "har_desimal_naer"), ("reject_00_run", "har_00_run"), ("reject_orgnr", "har_orgnr")):
                if c.get(rule):
                    bad |= on(feature)
            if c.get("reject_org_ord"):
                bad |= on("har_org_ord") & ((c["reject_org_ord"] < 2) | ~on("har_fnr_kandidat"))
            if c.get("reject_run_6_10"):
                bad |= (v["lang_run"] >= 6) & (v["lang_run"] <= (10 if c["reject_run_6_10"] == 1 else c["reject_run_6_10"]))
            out |= live & bad
        if "min_area_px" in c:
            out |= v["areal_px"] < c["min_area_px"]
        shape = np.zeros(n, bool)
        for name, (measure, below, _) in SHAPE.items():
            if name in c:
                shape |= v[measure] < c[name] if below else v[measure] > c[name]
        if "conf_threshold" in c:
            shape &= ~(v["conf"] >= c["conf_threshold"])
    return out | shape


def with_masks(preds: DataFrame, configs: list[tuple[str | None, dict]], keep: list[str]) -> DataFrame:
    """preds[keep] with m0, m1, ...: bit i of word j says whether config 62 j + i removes the row.

    configs are (kilde or null for all, parameters) on the driver; all of them are judged in one pass over the
    predictions, so that no row is multiplied by their number.
    """
    ready = [(k, validated(c)) for k, c in configs]
    words = -(-len(ready) // WORD)
    kinds = dict(preds.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"m{j} bigint" for j in range(words)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = {name: f[name].to_numpy(np.float64, na_value=np.nan) for name in INPUTS}
            source = f["kilde"].to_numpy()
            masks = np.zeros((words, len(f)), np.int64)
            # a config of one source judges the rows of that source only
            at = {kilde: slice(None) if kilde is None else np.flatnonzero(source == kilde) for kilde in {k for k, _ in ready}}
            parts = {kilde: {name: a[rows] for name, a in v.items()} for kilde, rows in at.items()}
            for i, (kilde, c) in enumerate(ready):
                masks[i // WORD][at[kilde]] |= removed_rows(parts[kilde], c).astype(np.int64) << np.int64(i % WORD)
            yield pd.concat([f[keep].reset_index(drop=True), pd.DataFrame({f"m{j}": masks[j] for j in range(words)})], axis=1)

    return preds.select(*dict.fromkeys([*keep, "kilde", *INPUTS])).mapInPandas(run, schema)
