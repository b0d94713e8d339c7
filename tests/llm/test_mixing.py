import pytest

from kvern.llm import mixing

DOCS = "doc_id bigint, text string, source string, n_copies string, part string"
AIMS = "source string, maal_andel double, maks_gjentak int"

pytest.importorskip("tiktoken")


def data(spark):
    docs = [(i, f"tekst nummer {i} om gnr {i * 7}", ["A-b ", "a_b", "lang"][i % 3], "", "") for i in range(300)]
    docs += [(1000 + i, f"liten {i}", "liten", "", "") for i in range(20)]
    docs += [(2000 + i, "samme tekst", "liten", "", "") for i in range(50)] + [(3000, None, "lang", "", ""), (3001, "", "lang", "", ""), (3002, "x", None, "", ""), (None, "y", "lang", "", "")]
    return spark.createDataFrame(docs, DOCS)


def test_shares_and_caps(spark):
    aims = spark.createDataFrame([("a_b", 0.4, 1), ("LANG", 0.3, 2), ("liten", 0.3, 4), ("borte", 0.5, 3), (None, 0.1, 1), ("nei", -1.0, 1)], AIMS)
    mix, _, give = mixing.mixture(data(spark), aims)
    rows = mix.collect()
    cap = {"a_b": 1, "lang": 2, "liten": 4}
    assert all(1 <= r["n_copies"] <= cap[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert sum(2000 <= r["doc_id"] < 3000 for r in rows) == 1
    got = {s: sum(r["n_tokens"] * r["n_copies"] for r in rows if r["source"] == s) for s in cap}
    assert all(give[s] - 20 <= got[s] <= give[s] for s in cap)
    shares = {r["source"]: r["share"] for r in mixing.mixed_shares(data(spark), aims).collect()}
    assert abs(shares["a_b"] - 0.4) < 0.05 and shares["borte"] == 0


def test_total_and_empty(spark):
    aims = spark.createDataFrame([("a_b", 0.5, 1), ("lang", 0.5, 2)], AIMS)
    mix, _, give = mixing.mixture(data(spark), aims, total=400)
    assert give == {"a_b": 200, "lang": 200}
    assert mixing.mixed_records(data(spark).limit(0), aims).count() == 0
    assert mixing.mixed_records(data(spark), aims.limit(0)).count() == 0


def test_counter_equals_the_tokenizer():
    c = mixing.counter(mixing.VOCABULARY)
    for text in ("Gnr. 12, b.nr. 3  på Øvre\n\nåsen!", "½ m² – “sitat”", "", "a_b__c 'll don't  \t x", "😀 tall 123456"):
        assert c.count(text) == len(c.encode(text))
