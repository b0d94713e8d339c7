import random

from kvern.llm import leaks

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string, sett string, doc_id string"


def data():
    rng = random.Random(6)
    vocabulary = [f"ord{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 16, 30]))), "test", "q") for i in range(25)]
    items += [(100, None, "x", None), (101, "", "x", None), (102, items[1][1].upper(), "x", None), (None, "a " * 20, "x", None)]
    docs = []
    for i in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            source = items[rng.randrange(25)][1].split()
            at = rng.randrange(max(1, len(source) - 8))
            ws[5:5] = source[at:]
        docs.append((i, " ; ".join(ws).replace("ord11", "ord1-\n1"), "z"))
    return docs + [(500, None, ""), (501, "", ""), (None, "x", "")] + docs[:4], items


def brute(docs, items, least):
    grams = {}
    for i, text, *_ in items:
        if i is not None and text:
            ws = leaks.words(text)
            for j in range(len(ws) - least + 1):
                grams.setdefault(tuple(ws[j : j + least]), set()).add(i)
    found = set()
    for d, text, *_ in docs:
        if d is not None and text:
            ws = leaks.words(text)
            for j in range(len(ws) - least + 1):
                found |= {(d, i) for i in grams.get(tuple(ws[j : j + least]), ())}
    return found


def test_found_matches_brute_force_in_any_blocks(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items, 16)
    assert want
    for block in (60, 2_000_000):
        assert {(r[0], r[1]) for r in leaks.leaked_items(d, i, block_words=block).collect()} == want
    assert {r["item_id"] for r in leaks.leak_report(d, i).collect()} == {x for _, x in want}


def test_cleaned_text_has_no_leak(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    cut = leaks.without_leaks(d, i, most_part=2.0).collect()
    assert {r["doc_id"] for r in cut} == {x for x, _ in brute(docs, items, 16)}
    assert all(r["cut_chars"] > 0 and r["text"] is not None for r in cut)
    assert all(r["text"] is None for r in leaks.without_leaks(d, i, most_part=0.0).collect())


def longest(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)


def test_lengths_are_those_of_the_item(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    texts, passages = {x: t for x, t, *_ in docs}, {x: t for x, t, *_ in items}
    for r in leaks.leaked_items(d, i).limit(12).collect():
        assert r["n_words"] == longest(leaks.words(texts[r["doc_id"]]), leaks.words(passages[r["item_id"]]))


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    both = lambda **k: (sorted(map(tuple, leaks.leaked_items(d, i, **k).collect())), sorted(map(tuple, leaks.without_leaks(d, i, most_part=2.0, **k).collect())))
    once = both()
    assert both(block_words=60) == once and len({r[0] for r in once[1]}) == len(once[1])
    automaton = next(leaks.automata(i, 16, 10**6))
    texts = [leaks.words(t) for _, t, *_ in docs if t]
    found = lambda: [[(a, x.tolist()) for a, _, x in f] for f in automaton.found(texts)]
    whole = found()
    monkeypatch.setattr(leaks, "PIECE", 3)
    assert found() == whole


def test_one_id_with_two_texts(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"før {item} etter, og mye mer tekst som står her og står her", ""), (1, f"noe helt annet før {item} slutt", ""), (1, f"noe helt annet før {item} slutt", "")]
    cut = leaks.without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item, "x", "")], ITEMS), most_part=2.0).collect()
    assert sorted(r["text"] for r in cut) == ["før  etter, og mye mer tekst som står her og står her", "noe helt annet før  slutt"]


def test_words():
    assert leaks.words("Gård-\nen A_B 12,5 – É") == ["gården", "a", "b", "12", "5", "é"]
    assert [w for w, _, _ in leaks.placed_words("Gård-\nen A")] == ["gården", "a"]
    assert leaks.placed_words("Gård-\nen A")[0][1:] == (0, 8)


def test_empty(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leaks.leaked_items(d.limit(0), i).count() == 0
    assert leaks.leaked_items(d, i.limit(0)).count() == 0
