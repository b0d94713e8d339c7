import random

from kvern.llm import spans

SCHEMA = "doc_id bigint, text string, cls string, sig string"


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh æøå😀\n") for _ in range(n))
    shared, long, short = text(300), text(900), text(299)
    docs = {1: text(100) + shared + text(200), 2: shared, 3: text(500) + shared, 4: text(50) + short + "X", 5: short + "Y" + text(400), 6: long, 7: long, 8: text(10) + long[:450] + text(30), 9: text(20) + long[440:], 10: "", 11: None, 12: text(20000), 13: "a" * 700, 14: "a" * 500, 15: "b" + "ab" * 300}
    rows = [(k, v, "x", "y") for k, v in docs.items()]
    return docs, rows + rows[:3] + [(None, shared, "x", "y")]


def brute(docs, span):
    grams = {}
    for k, t in docs.items():
        for i in range(len(t or "") - span + 1):
            grams.setdefault(t[i : i + span], set()).add(k)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}, {k: sum(_covered(t or "", grams, k, span)) for k, t in docs.items()}


def _covered(t, grams, k, span):
    hit = [False] * len(t)
    for i in range(len(t) - span + 1):
        if len(grams[t[i : i + span]]) > 1:
            hit[i : i + span] = [True] * span
    return hit


def test_pairs_and_portions_match_brute_force(spark):
    docs, rows = corpus()
    data = spark.createDataFrame(rows, SCHEMA)
    pairs, covered = brute(docs, 300)
    assert {(r[0], r[1]) for r in spans.shared_pairs(data).collect()} == pairs
    assert {(r[0], r[1]) for r in spans.shared_pairs(data, crowd=1).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_portion(data, crowd=1).collect()} == {k: n for k, n in covered.items() if n}
    out = {r["doc_id"]: r for r in spans.shared_portion(data).collect()}
    assert {k: r["shared_chars"] for k, r in out.items()} == {k: n for k, n in covered.items() if n}
    assert out[6]["gruppe"] == out[9]["gruppe"] == 6 and out[6]["keep"] and not out[7]["keep"]
    assert out[2]["gruppe"] == out[3]["gruppe"] == 1


def test_empty(spark):
    assert spans.shared_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spans.shared_portion(spark.createDataFrame([(1, None, "", "")], SCHEMA)).count() == 0


def test_a_crowd_is_linked_without_pairs(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, phrase = text(320), text(150)
    rows = [(i, text(200) + passage + text(100), "", "") for i in range(50)] + [(100 + i, text(200) + phrase + text(100), "", "") for i in range(50)]
    out = spans.shared_portion(spark.createDataFrame(rows, SCHEMA), crowd=8).collect()
    assert {r["doc_id"] for r in out} == set(range(50)) and {r["gruppe"] for r in out} == {0} and {r["n_links"] for r in out} == {49}
    assert all(320 <= r["shared_chars"] <= 330 for r in out)


def test_a_crowded_phrase_below_half_a_window_makes_no_windows(spark):
    import random

    rng = random.Random(12)
    phrase = "".join(rng.choice("abcdefghij ") for _ in range(70))
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(i, noise(400) + phrase + noise(400)) for i in range(60)]
    rows.append((60, rows[3][1][200:700]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, windows, _ = spans.shared_runs(docs, crowd=8)
    assert {bytes(r["cls"]) for r in windows.collect()} <= {spans._digest(rows[3][1]), spans._digest(rows[60][1])}
    assert {tuple(r) for r in spans.shared_pairs(docs, crowd=8).collect()} == {(3, 60)}


def test_one_id_with_two_texts_keeps_both(spark):
    one, two = "a1 b2 c3 d4 " * 40, "".join(chr(97 + (i * i) % 26) for i in range(450))
    docs = spark.createDataFrame([(1, one), (1, two), (2, "x" + one), (3, "y" + two)], "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(docs).collect()} == {(1, 2), (1, 3)}


def test_the_paragraph_method_finds_like_paragraphs_only(spark):
    p = " ".join(f"ord{i}" for i in range(80)) + ".\n"
    q = " ".join(f"noe{i}" for i in range(80)) + ".\n"
    docs = spark.createDataFrame([(1, p + q), (2, p), (3, "annet " + q[:300]), (4, None), (5, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in spans.paragraph_pairs(docs).collect()} == {(1, 2)}
