import random

import numpy as np

from kvern.llm import pii
from kvern.llm.crf import SkipChainCRF

NAMES = ["Kari", "Ola", "Dag", "Stein", "Per-Olav"]
LEXICON = pii.Lexicon(NAMES, {"runar", "ottilie"}, {"angmo", "gvoll", "kvern"})


def number(rng):
    """A computed identity number of a birth year and series that no register used."""
    while True:
        d = [int(c) for c in f"{rng.randrange(1, 29):02}{rng.randrange(1, 13):02}{rng.randrange(55, 61)}{rng.randrange(500, 750)}"]
        a = 11 - (3 * d[0] + 7 * d[1] + 6 * d[2] + d[3] + 8 * d[4] + 9 * d[5] + 4 * d[6] + 5 * d[7] + 2 * d[8]) % 11
        d.append(a % 11)
        b = 11 - (5 * d[0] + 4 * d[1] + 3 * d[2] + 2 * d[3] + 7 * d[4] + 6 * d[5] + 5 * d[6] + 4 * d[7] + 3 * d[8] + 2 * d[9]) % 11
        d.append(b % 11)
        if max(d) < 10:
            return "".join(map(str, d))


def sentences(rng, n):
    """(text, cases) made from parts; cases are (kind, start)."""
    surnames = [a + b for a in ("Nord", "Sør", "Vest", "Øst", "Små") for b in ("hagtangmo", "vikbergvoll", "elvdalkvern")]
    given, out = NAMES + ["Runar", "Ottilie"], []
    for _ in range(n):
        g, s, num = rng.choice(given), rng.choice(surnames), number(rng)
        phone = rng.choice(["22334455", "22 33 44 55", "+47 22334455", "+46 70-174 06 98"])
        street = rng.choice(["Kirkeveien 12", "Øvre Bekkesvingen 7B", "Naust allé 25", "Ospegt. 73"])
        mail = rng.choice(["ola.nord@post.example", "ola_nord [at] post.test", "ola@post. test"])
        parts = rng.choice([
            [("Selger ", None), (f"{g} {s}", "navn"), (" nr 12 ", None), (num, "fnr")], [("Vitne: ", None), (f"{s}, {g}", "navn"), (". Bopel: ", None), (street, "adresse")],
            [("tlf. ", None), (phone, "telefon"), (" e-post: ", None), (mail, "epost")], [("saksnr 22334455 fra ", None), (f"{s} Maskin AS", None)], [("langs Kirkegata til grensepunkt 14", None)],
            [("kontonr 12345678903 tilhører ", None), (f"K. {s}", "navn")], [("Dag for overtagelse: 010203", None)], [("tomt nr 5 i Nordsanden, målt 1.2.1950", None)],
        ])
        text, cases = "", []
        for t, k in parts:
            if k:
                cases.append((k, len(text)))
            text += t
        out.append((text, set(cases)))
    return out


def test_held_out_accuracy():
    train, held = sentences(random.Random(1), 1500), sentences(random.Random(2), 500)
    finder = pii.fit([t for t, _ in train], LEXICON)
    found = finder.find([t for t, _ in held])
    right = sum(len({(k, s) for k, s, _ in f} & c) for f, (_, c) in zip(found, held))
    assert right / sum(len(f) for f in found) > 0.98 and right / sum(len(c) for _, c in held) > 0.98


def test_views_and_numbers():
    stored = '"st\\u00e5r \\u00d8. Nord\\nVei"'
    v, places = pii.view(stored)
    assert v == '"står Ø. Nord\nVei"' and stored[places[v.index("Ø")] :].startswith("\\u00d8")
    assert pii.view("bl&aring; & x")[0] == "blå & x"
    n = number(random.Random(3))
    spaced = f"{n[:2]}. {n[2:4]}.{n[4:6]} {n[6:]}"
    assert pii.identity_numbers(f"nr 12 {spaced};") == [(6, 6 + len(spaced))]
    assert pii.identity_numbers(n.replace("0", "O").replace("1", "l").replace("5", "S")) in ([(0, 11)], [])
    assert pii.identity_numbers(n[:6] + "   " + n[6:]) == [] and pii.identity_numbers("7" + n) == [] and pii.identity_numbers(n[:10] + str((int(n[10]) + 1) % 10)) == []


def test_loopy_beliefs_equal_enumeration_on_one_edge():
    """With one skip edge between the ends of a two-token chain's neighbour the graph has one loop; with no loop the beliefs are exact."""
    rng = np.random.default_rng(2)
    m = SkipChainCRF(["a", "b", "c"], [0, 1, 1], rounds=8)
    m.step, m.first, m.same = rng.normal(size=(3, 3)), rng.normal(size=3), np.zeros(2)
    node = rng.normal(size=(1, 3, 3))
    belief = m.beliefs(node, np.ones((1, 3), bool), np.array([[0, 0, 2, 1]]))[0]
    total = np.zeros((3, 3))
    for x in range(3):
        for y in range(3):
            for z in range(3):
                p = np.exp(m.first[x] + node[0, 0, x] + m.step[x, y] + node[0, 1, y] + m.step[y, z] + node[0, 2, z])
                total[0, x] += p
                total[1, y] += p
                total[2, z] += p
    assert np.allclose(belief[0], total / total.sum(axis=1, keepdims=True))
    m.same = np.full(2, 2.0)
    tied = m.beliefs(node, np.ones((1, 3), bool), np.array([[0, 0, 2, 1]]))[0]
    agree = lambda b: (b[0] @ m.onehot * (b[2] @ m.onehot)).sum()
    assert agree(tied[0]) > agree(belief[0])


def test_masking_keeps_the_rest(spark):
    manifest = spark.createDataFrame([(1, "Selger Kari Nordtangmo og tlf. 22334455", "x"), (2, None, "x"), (3, "", "x"), (None, "tlf. 22334455", "x"), (1, "Selger Kari Nordtangmo og tlf. 22334455", "x"), (4, "lån @ 4,5 % " * 4000, "x")], "nr bigint, ocr_tekst string, tekst string")
    verdicts = spark.createDataFrame([(7, '{"linjen": "e-post: ola@post.example"}', "Ingen dato.", "f")], "verdict_id bigint, raatekst string, begrunnelse string, felt string")
    names = spark.createDataFrame([("Kari",), (None,), ("",)], "navn string")
    out = {(r["felt"], r["rad_id"]): r["tekst"] for r in pii.masked(manifest, verdicts, names).collect()}
    assert out[("ocr_tekst", 2)] is None and out[("ocr_tekst", 3)] == "" and out[("begrunnelse", 7)] == "Ingen dato."
    assert out[("raatekst", 7)] == '{"linjen": "e-post: [EPOST]"}' and out[("ocr_tekst", None)] == "tlf. [TELEFON]"
    assert out[("ocr_tekst", 4)] == "lån @ 4,5 % " * 4000
    cases = {tuple(r)[:4] for r in pii.occurrences(manifest, verdicts, names).collect()}
    assert ("raatekst", 7, "epost", 20) in cases and ("ocr_tekst", 1, "telefon", 31) in cases and all(c[1] is not None for c in cases)
    assert pii.occurrences(manifest.limit(0), verdicts.limit(0), names.limit(0)).count() == 0


def test_edges_find_what_the_chain_alone_misses():
    """A name told clearly once is found where it is repeated, also in capitals or misread; without the edges these are lost."""
    finder = pii.fit([t for t, _ in sentences(random.Random(1), 1500)], LEXICON)
    texts = ["Selger Kari Bygdemyren nr 12 x. så kom Kari Bygdemyren", "Selger Kari Bygdemyren nr 12 x. x Kari Bygtemyren y", "Selger Ottilie Haugsand nr 12 x. Merk OTTILIE HAUGSAND"]
    names = lambda: [sorted(x[s:e] for k, s, e in f if k == "navn") for x, f in zip(texts, finder.find(texts))]
    assert names() == [["Kari Bygdemyren"] * 2, ["Kari Bygdemyren", "Kari Bygtemyren"], ["OTTILIE HAUGSAND", "Ottilie Haugsand"]]
    finder.linked = False
    assert all(without != with_ for without, with_ in zip(names(), [["Kari Bygdemyren"] * 2, ["Kari Bygdemyren", "Kari Bygtemyren"], ["OTTILIE HAUGSAND", "Ottilie Haugsand"]]))


def test_similar_tokens_are_joined():
    edges = lambda *words: pii.skip_edges([("word", w) for w in words])
    assert edges("Bygdemyren", "og", "BYGDEMYREN") == [(0, 2, 0)]
    assert edges("Bygdemyren", "Bygtemyren") == [(0, 1, 1)] and edges("Bygdemyren", "Bygdmyren") == [(0, 1, 1)]
    assert edges("Nordby-Haugsand", "Haugsand") == [(0, 1, 1)] and edges("Bygdemyren", "Haugsand") == []


def test_batches_hold_few_cells():
    lengths = np.array([5] * 400 + [90_000] + [0] + [300] * 300)
    seen = [(len(b), int(lengths[b].max())) for b in SkipChainCRF.batches(lengths)]
    assert sum(n for n, _ in seen) == 701 and all(n == 1 or n * longest <= 1 << 15 for n, longest in seen)


def test_a_long_text_is_read_as_its_parts():
    finder = pii.fit([t for t, _ in sentences(random.Random(1), 600)], LEXICON)
    parts = [t for t, _ in sentences(random.Random(9), 400)]
    alone = sum(len(f) for f in finder.find(parts))
    whole = finder.find([" \n. ".join(parts)])[0]
    assert abs(len(whole) - alone) < 0.05 * alone


def test_lexicon_counts_all_texts(spark):
    rows = [(f"Selger Kari Nord{i % 7}vikbakkmo og {'Zoltan' if i % 4 else 'Imre'} Nordvikbakkmo kom",) for i in range(200)]
    lexicon = pii.lexicon(spark.createDataFrame(rows + [(None,), ("",)], "tekst string").where("tekst <> ''"), spark.createDataFrame([("Kari",), (None,), (" ",)], "navn string"))
    assert lexicon.given == {"kari"} and "akkmo" in lexicon.surname and {"zoltan", "imre"} <= lexicon.learned
    assert pii.lexicon(spark.createDataFrame([], "tekst string"), spark.createDataFrame([], "navn string")).surname == set()
