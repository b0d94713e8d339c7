"""The rule engine three ways: Columns, vectorised masks, and a plain restatement here."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvern.operators import rules

FIELDS = ["conf", "elongation", "h", "w", "short_side", "long_side", "area", "areal_px", *rules.TEXT_FEATURES]


def random_box(rng):
    short = rng.uniform(0.5, 60)
    long = short + rng.uniform(0, 200)
    has = rng.random() < 0.8
    flag = lambda: rng.choice([None, 0.0, 1.0])
    rec = lambda: rng.choice([None, 0.5, 0.9, 0.95, 0.97, 0.985, 0.995, 0.9999])
    return {
        "conf": None if rng.random() < 0.2 else rng.random(), "elongation": long / short, "h": short, "w": long, "short_side": short, "long_side": long, "area": short * long, "areal_px": short * long * (300 / 72) ** 2,
        "har_tokens": float(has) if rng.random() < 0.95 else None, "n_siffer": float(rng.randrange(15)) if has else None, "n_bokstaver": float(rng.randrange(4)) if has else None, "rec_min": rec(), "rec_min_linje": rec(),
        "siffer_run": float(rng.randrange(12)) if has else None, "har_fnr_kandidat": flag(), "har_desimal_naer": flag(), "har_00_run": flag(), "har_orgnr": flag(), "har_org_ord": flag(),
        "lang_run": rng.choice([None, 3.0, 5.0, 6.0, 8.0, 10.0, 11.0]), "maks_luke": rng.choice([None, 0.0, 3.0, 6.5, 12.0]), "har_desimal_luke": flag(),
    }


def restated(p, c):
    yes = lambda x: bool(x)

    def text():
        if "without_text_conf" in c and p["har_tokens"] == 0 and (p["conf"] is None or p["conf"] < c["without_text_conf"]):
            return True
        if yes(c.get("reject_decimal_gap")) and yes(p["har_desimal_luke"]):
            return True
        if "max_gap" in c and p["maks_luke"] is not None and p["maks_luke"] >= c["max_gap"]:
            return True
        if not yes(p["har_tokens"]):
            return False
        if "ocr_conf_exempt" in c and p["conf"] is not None and p["conf"] >= c["ocr_conf_exempt"]:
            return False
        for veto, read in (("rec_veto", "rec_min"), ("line_veto", "rec_min_linje")):
            if veto in c and (p[read] is None or p[read] < c[veto]):
                return False
        longest = 10 if c.get("reject_run_6_10") == 1 else c.get("reject_run_6_10", 0)
        return any([
            "min_digits" in c and (p["n_siffer"] or 0) < c["min_digits"], "max_letters" in c and (p["n_bokstaver"] or 0) > c["max_letters"], "min_digits_run" in c and (p["siffer_run"] or 0) < c["min_digits_run"],
            yes(c.get("require_fnr_candidate")) and not yes(p["har_fnr_kandidat"]), yes(c.get("reject_decimal")) and yes(p["har_desimal_naer"]), yes(c.get("reject_00_run")) and yes(p["har_00_run"]),
            yes(c.get("reject_orgnr")) and yes(p["har_orgnr"]), yes(c.get("reject_org_ord")) and yes(p["har_org_ord"]) and (c["reject_org_ord"] < 2 or not yes(p["har_fnr_kandidat"])),
            longest and p["lang_run"] is not None and 6 <= p["lang_run"] <= longest,
        ])

    if text() or "min_area_px" in c and p["areal_px"] < c["min_area_px"]:
        return True
    if "conf_threshold" in c and p["conf"] is not None and p["conf"] >= c["conf_threshold"]:
        return False
    return any(name in c and (p[m] < c[name] if below else p[m] > c[name]) for name, (m, below, _) in rules.SHAPE.items())


CONFIGS = [c for _, c in rules.PRODUCTION.values()] + [
    {"min_elongation": 1.4, "max_height": 40, "conf_threshold": 0.5}, {"min_area_px": 965, "max_long_side": 120}, {"max_area": 900, "min_width": 20, "max_width": 150, "min_height": 4},
    {"min_digits": 5, "max_letters": 1, "min_digits_run": 6, "reject_00_run": 1}, {"reject_org_ord": 2, "without_text_conf": 0.4, "reject_run_6_10": 1, "line_veto": 0.99}, {"max_short_side": 30, "min_short_side": 5, "min_long_side": 20, "max_elongation": 9}, {},
]


def test_three_ways_agree(spark):
    rng = random.Random(11)
    boxes = [random_box(rng) for _ in range(1500)]
    df = spark.createDataFrame([(i, *(b[f] for f in FIELDS)) for i, b in enumerate(boxes)], "i int, " + ", ".join(f"{f} double" for f in FIELDS))
    cols = [F.col("i")]
    for k, c in enumerate(CONFIGS):
        cols += [rules.removed(rules.literal(c), F.col).alias(f"r{k}"), (F.size(rules.reasons(rules.literal(c), F.col)) > 0).alias(f"w{k}")]
    rows = sorted(df.select(*cols).collect())
    v = {f: np.array([np.nan if b[f] is None else b[f] for b in boxes]) for f in FIELDS}
    for k, c in enumerate(CONFIGS):
        want = [restated(b, rules.validated(c)) for b in boxes]
        assert [r[f"r{k}"] for r in rows] == want
        assert [r[f"w{k}"] for r in rows] == want
        assert list(rules.removed_rows(v, rules.validated(c))) == want


BASE = {f: None for f in FIELDS} | {"elongation": 4.0, "h": 10.0, "w": 40.0, "short_side": 10.0, "long_side": 40.0, "area": 400.0, "areal_px": 6944.0, "har_tokens": 1.0, "rec_min": 0.99, "conf": 0.3}


@pytest.mark.parametrize("change, config, gone", [
    ({"elongation": 8.0, "conf": 0.4}, {"max_elongation": 6, "conf_threshold": 0.5}, True), ({"elongation": 8.0, "conf": 0.6}, {"max_elongation": 6, "conf_threshold": 0.5}, False),
    ({"areal_px": 500.0, "conf": 0.99}, {"min_area_px": 965, "conf_threshold": 0.5}, True), ({"har_desimal_naer": 1.0, "conf": 0.99}, {"reject_decimal": 1, "conf_threshold": 0.5}, True),
    ({"har_desimal_naer": 1.0, "conf": 0.99}, {"reject_decimal": 1, "ocr_conf_exempt": 0.6}, False), ({"har_desimal_naer": 1.0, "rec_min": 0.9}, {"reject_decimal": 1, "rec_veto": 0.98}, False),
    ({"har_desimal_naer": 1.0, "rec_min": None}, {"reject_decimal": 1, "rec_veto": 0.98}, False), ({"har_tokens": 0.0}, {"min_digits": 5}, False), ({"har_org_ord": 1.0, "har_fnr_kandidat": 1.0}, {"reject_org_ord": 2}, False),
    ({"har_org_ord": 1.0, "har_fnr_kandidat": 0.0}, {"reject_org_ord": 2}, True), ({"lang_run": 10.0}, {"reject_run_6_10": 1}, True), ({"lang_run": 5.0}, {"reject_run_6_10": 1}, False), ({"lang_run": 10.0}, {"reject_run_6_10": 8}, False),
    ({"har_tokens": None, "maks_luke": 7.0}, {"max_gap": 6.5, "reject_decimal_gap": 1}, True), ({"elongation": 0.0}, {"min_elongation": 1.44}, True),
])
def test_edges(change, config, gone):
    b = BASE | change
    v = {f: np.array([np.nan if b[f] is None else b[f]]) for f in FIELDS}
    assert bool(rules.removed_rows(v, rules.validated(config))[0]) == gone == restated(b, rules.validated(config))


def test_unknown_parameter():
    with pytest.raises(TypeError):
        rules.validated({"min_elongasjon": 1})
