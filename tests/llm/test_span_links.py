import random

from kvern.llm import spans


def test_links_of_a_text_in_several_crowds(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two, three = text(330), text(330), text(330)
    docs = {0: one + text(60) + two + text(60) + three}
    docs |= {1 + i: text(150) + one + text(50) for i in range(39)} | {101 + i: text(150) + two + text(50) for i in range(39)}
    docs |= {201 + i: text(80) + three + text(50) for i in range(3)}
    docs[300] = text(90) + one + text(70) + three + text(20)  # linked to 0 in a crowd and outside
    docs[301] = docs[300]
    grams = {}
    for k, t in docs.items():
        for i in range(len(t) - 299):
            grams.setdefault(t[i : i + 300], set()).add(k)
    # linked texts, not documents, and one more for a text held twice
    want = {k: len({docs[o] for s in grams.values() if k in s for o in s}) - 1 + (k > 299) for k in docs}
    rows = [(k, t, "", "") for k, t in docs.items()]
    for crowd in (8, 32, 1):
        out = spans.shared_portion(spark.createDataFrame(rows, "doc_id bigint, text string, cls string, sig string"), crowd=crowd).collect()
        assert {r["doc_id"]: r["n_links"] for r in out} == want
    assert want[0] == 39 + 39 + 3 + 1 and want[1] == 40
