import math
import random

import pytest
from pyspark.sql import functions as F

from kvern.functions import geometry as g
from kvern.functions import keys, numbers, scalar, text


def made_number(rng, d_number=False):
    """A computed number of a birth year and series that no register used; check digits by their own arithmetic."""
    while True:
        day = rng.randrange(1, 29) + 40 * d_number
        s = f"{day:02}{rng.randrange(1, 13):02}{rng.randrange(55, 61)}{rng.randrange(500, 750)}"
        x = [int(c) for c in s]
        for weights in ((3, 7, 6, 1, 8, 9, 4, 5, 2), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)):
            x.append((11 - sum(w * d for w, d in zip(weights, x)) % 11) % 11)
        if max(x) < 10:
            return "".join(map(str, x))


def texts():
    rng = random.Random(9)
    out = ["", "12345678901", "Dag 5. mai", None]
    for _ in range(120):
        n = made_number(rng, rng.random() < 0.3)
        gap = lambda: rng.choice(["", "", " ", ".", ". ", "-", "   ", "/", "x"])
        spelled = n[:2] + gap() + n[2:4] + gap() + n[4:6] + gap() + n[6:]
        for a, b in (("0", "O"), ("1", "l"), ("5", "S"), ("6", "b")):
            if rng.random() < 0.3:
                spelled = spelled.replace(a, b, 1)
        out += [spelled, f"fnr {spelled} og {made_number(rng)}", f"{rng.randrange(10**6)} {spelled},{rng.randrange(100)}", n[:10] + str((int(n[10]) + 1) % 10), f"7{n}"]
    return out


def test_scan_in_the_jvm_equals_python(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string")
    rows = df.select("i", numbers.find_numbers(F.col("t")).alias("a"), numbers.find_numbers(F.col("t"), mod11=False).alias("b"), scalar.find_numbers_udf("t").alias("c")).collect()
    for r in rows:
        t = ts[r["i"]]
        assert [tuple(x) for x in r["a"] or []] == scalar.find_numbers(t) == [tuple(x) for x in r["c"]]
        assert [tuple(x) for x in r["b"] or []] == scalar.find_numbers(t, mod11=False)


def test_scan_cases():
    n = made_number(random.Random(1))
    spelled = f"{n[:2]}. {n[2:4]}. {n[4:6]} {n[6:]}"
    assert [h[:2] for h in scalar.find_numbers(spelled)] == [(0, len(spelled))]
    assert len(scalar.find_numbers(f"{n} {n}")) == 2
    assert not scalar.find_numbers(n[:6] + "x" + n[6:]) and not scalar.find_numbers(n[:6] + "   " + n[6:]) and not scalar.find_numbers(n[:6] + "/" + n[6:])
    assert not scalar.find_numbers(f"{n[:2]} {n[2:4]} {n[4:6]} {n[6:8]} {n[8:]}")
    for i in range(11):
        wrong = n[:i] + str((int(n[i]) + 1) % 10) + n[i + 1 :]
        assert not scalar.valid_mod11(wrong)
    assert not scalar.identity_form("32010150000") and not scalar.identity_form("72010150000") and not scalar.identity_form("01130150000")


def test_column_checks(spark):
    rng = random.Random(4)
    good = [made_number(rng) for _ in range(20)]
    rows = [(x,) for x in good + [x[:-1] + str((int(x[-1]) + 3) % 10) for x in good] + ["", "abc", None, "1234567890"]]
    got = spark.createDataFrame(rows, "t string").select("t", numbers.valid_mod11(F.col("t")).alias("v"), numbers.identity_form(F.col("t")).alias("f")).collect()
    assert all(r["v"] == scalar.valid_mod11(r["t"]) for r in got)
    org = [(f"{a}{(11 - sum(w * int(c) for w, c in zip((3, 2, 7, 6, 5, 4, 3, 2), str(a))) % 11) % 11}",) for a in range(91000000, 91000040)]
    got = spark.createDataFrame(org + [("912345678",), (None,)], "t string").select("t", numbers.valid_orgnr(F.col("t")).alias("v")).collect()
    assert all(r["v"] == scalar.valid_orgnr(r["t"]) == (r["t"] is not None and len(r["t"]) == 9 and r["t"] != "912345678") for r in got)


def test_strict_numbers(spark):
    n = made_number(random.Random(2))
    d = made_number(random.Random(2), d_number=True)

    def shifted(by):
        rng = random.Random(by)
        while True:
            x = [int(c) for c in f"{rng.randrange(1, 29):02}{rng.randrange(1, 13) + by:02}{rng.randrange(55, 61)}{rng.randrange(500, 750)}"]
            for weights in ((3, 7, 6, 1, 8, 9, 4, 5, 2), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)):
                x.append((11 - sum(w * v for w, v in zip(weights, x)) % 11) % 11)
            if max(x) < 10:
                return "".join(map(str, x))

    rows = [(f"a {n} b",), (f"x\n  {n[:2]}.{n[2:4]}.{n[4:6]} {n[6:]}",), (f"9{n}",), (f"{n}1",), (None,), (f"{n} # fnr-ok\n{d}",), (shifted(40),), (shifted(80),), ("",)]
    got = [None if r[0] is None else [tuple(h) for h in r[0]] for r in spark.createDataFrame(rows, "t string").select(numbers.strict_numbers(F.col("t"))).collect()]
    assert got == [[(1, 3, "fnr")], [(2, 3, "fnr")], [], [], None, [(2, 1, "d-nummer")], [(1, 1, "h-nummer")], [(1, 1, "synthetic")], []]


def test_company_words(spark):
    said = {"Nord AS": True, "NORD BA": False, "SA DA": False, "Vest IKS": True, "BRL 4": True, "Sparebanken": True, "as": False}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", numbers.has_org_word(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == said


def test_crop_with_marker(spark):
    df = spark.createDataFrame([(1000.7, 500.2, 1200.0, 540.0), (-5.0, 0.0, 0.0, 9.0), (100.0, 100.0, 100.2, 100.2)], "x0 double, y0 double, x1 double, y1 double")
    crop = lambda *margins, **k: [r["s"] for r in df.select(g.crop_with_marker(g.Box.of(), F.lit(2480), F.lit(3508), *margins, **k).alias("s")).collect()]
    a, b, c = crop(300.0, 60.0, -1.0, 60.0)
    assert (a["reason"], tuple(a["crop"]), a["factor"]) == (None, (700.0, 440.0, 2480.0, 600.0), 1.0)
    # the crop is 1780 wide, so the stroke is round(4.45) = 4 and the pad 6
    assert tuple(round(x, 3) for x in a["marker"]) == (294.7, 54.2, 506.0, 106.0) and b["reason"] == "outside" and b["crop"] is None and c["reason"] is None
    a, _, _ = crop(300.0, 60.0, -1.0, 60.0, widest=768)
    assert round(a["factor"], 6) == round(768 / 1780, 6) and round(a["marker"]["x0"], 3) == round(300.7 * 768 / 1780 - 5, 3)
    assert crop(0.0, 0.0, 0.0, 0.0)[2]["reason"] == "empty"


def test_poisson_bound():
    assert abs(scalar.poisson_upper(0) - 2.9957) < 1e-3 and abs(scalar.poisson_upper(1) - 4.7439) < 1e-3
    assert all(scalar.poisson_upper(k + 1) > scalar.poisson_upper(k) for k in range(60)) and math.isfinite(scalar.poisson_upper(500))


ANSWERS = [
    (None, "ja", "empty answer"), ("  ", "ja", "empty answer"), ('{"svar": "Nei ", "tall": 5}', "nei", ""), ('```json\n{"svar": "ja"}\n```', "ja", ""), ('Svaret: {"svar": "nei"} takk', "nei", ""), ("Nei, det er ikke det", "nei", "not JSON, read by keyword"),
    ("{}", "ja", text.OMITTED), ('{"svar": "kanskje", "begrunnelse": "nei, ikke det"}', "ja", "unknown answer 'kanskje'"), ('{"svar": null}', "ja", "unknown answer 'none'"), ("<html>", "ja", "unparsable answer"), ("[1]", "ja", "unparsable answer"), ('{"svar": "nei', "nei", "not JSON, read by keyword"),
]


def test_answers(spark):
    got = {r["i"]: r["answer"] for r in text.with_answer(spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, t string"), "t").collect()}
    assert [(got[i]["svar"], got[i]["feil"]) for i in range(len(ANSWERS))] == [a[1:] for a in ANSWERS]
    assert got[2]["tall"] == "5" and got[7]["begrunnelse"] == "nei, ikke det" and got[5]["begrunnelse"] == "Nei, det er ikke det"
    long = text.with_answer(spark.createDataFrame([('{"svar": "ja", "linjen": "' + "a\\nb" * 200 + '", "holdepunkt": null}',)], "t string"), "t").first()["answer"]
    assert len(long["linjen"]) == 300 and long["linjen"].startswith("a b") and long["holdepunkt"] == ""


def test_keys(spark):
    said = {"uttrekk_1/0012.pdf": 12, " 34": 34, "56.0": 56, "7_p3.png": 7, "skann/8_side1.PNG": 8, "ukjent": None, "": None, "12/abc": None, "0": 0, None: None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", keys.doc_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == said
    values = {"1,5": 1.5, " -2": -2.0, "6.1e+01": 61.0, "nan": None, "inf": None, "-": None, None: None}
    rows = spark.createDataFrame([(k,) for k in values], "t string").select("t", keys.number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == values
    pages = {" 2": 2, "2.0": 2, "2.5": None, "x": None, "100": 100}
    rows = spark.createDataFrame([(k,) for k in pages], "t string").select("t", keys.whole_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == pages


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 4.0, 5.0, 2.0, 15.0, 6.0), (0.0, 0.0, 10.0, 4.0, 10.0, 0.0, 20.0, 4.0), (3.0, 3.0, 3.0, 9.0, 0.0, 0.0, 9.0, 9.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = g.Box.of("a"), g.Box.of("b")
    r = df.select(g.intersection_area(a, b).alias("i"), g.covered_share(a, b).alias("c"), g.smallest_share(a, b).alias("s"), g.same_box(a, b).alias("m")).collect()
    assert [x["i"] for x in r] == [10.0, 0.0, 0.0] and [x["c"] for x in r] == [0.25, 0.0, 0.0] and [x["s"] for x in r] == [0.25, 0.0, 0.0] and r[2]["m"]
    for q in range(4):
        once = g.turned(a, F.lit(20.0), F.lit(30.0), F.lit(q))
        back = g.unturned(once, F.lit(20.0), F.lit(30.0), F.lit(q))
        assert all(x[0] for x in df.select(g.equal_within(back, a, 1e-9)).collect())
    places = df.select(g.placement(g.Box(a.x0 - 1, a.y0, a.x1, a.y1), F.lit(10.0), F.lit(9.0)).alias("p"), g.placement(g.Box(a.x0 + 10, a.y0, a.x1 + 10, a.y1), F.lit(10.0), F.lit(9.0)).alias("q")).first()
    assert tuple(places) == ("inside", "outside")
    with pytest.raises(ValueError):
        g.passes("areal", 0.3)


def test_conditions(spark):
    df = spark.createDataFrame([("0.5", "nei"), ("x", "ja"), (None, ""), ("0.7", "nei")], "conf string, svar string")
    assert [r[0] for r in df.select(text.condition(df, "conf>=0.6")).collect()] == [False, True, False, True]
    assert [r[0] for r in df.select(text.condition(df, "svar!=ja")).collect()] == [True, False, False, True]
    with pytest.raises(ValueError):
        text.condition(df, "conf~1")


def test_registered_functions(spark):
    numbers.register(spark)
    n = made_number(random.Random(3))
    r = spark.sql(f"select valid_mod11('{n}') a, size(find_fnr('x {n}')) b, poisson_upper(0) c, iou(0D, 0D, 2D, 2D, 1D, 0D, 3D, 2D) d, parse_answer('nei').svar e").first()
    assert r["a"] and r["b"] == 1 and abs(r["c"] - 2.9957) < 1e-3 and abs(r["d"] - 1 / 3) < 1e-12 and r["e"] == "nei"
