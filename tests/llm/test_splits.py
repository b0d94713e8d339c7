import random

from kvern.llm import components, splits

LABELS = "id string, fil_revisjon_id string, sidetall string, type string, versjon int, lastet timestamp, n string, label string"
META = "fil_revisjon_id string, forrige_revisjon_id string, embetenummer int, dokument_aar int, dokumentnummer bigint, root string"


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 700)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges + [(None, 3), (7, 7)], "a bigint, b bigint")).collect()}
    want = union_find([(a, b) for a, b in edges if a != b])
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def tables(spark):
    meta = [("1", None, 1, 2000, 5, None), (" 2", None, 1, 2000, 5, None), ("3.pdf", "2.0", None, 2000, 0, None), ("4", "99", 1, 2001, 5, None), ("5", None, 1, 2001, 0, None), ("6", None, 1, 2001, 0, None), (None, "1", 1, 2000, 5, None)]
    rows = []
    for doc in (1, 2, 3, 4, 5, 6, 7):
        for k in range(20 if doc == 7 else 4):
            rows.append((f"{doc}-{k}", [str(doc), f" {doc}", f"{doc}.0"][k % 3], "1", ["FNR", " fnr", "DNR", None][k % 4], None, None, "x", "y"))
    rows += [(None, "ukjent", None, None, None, None, None, None), ("z", None, "2", "FNR", 1, None, None, None), rows[0]]
    return spark.createDataFrame(rows, LABELS), spark.createDataFrame(meta, META), rows


def test_related_documents(spark):
    labels, meta, _ = tables(spark)
    got = sorted((r[0], r[1]) for r in splits.related_documents(labels, meta).collect())
    assert got == [(1, 1), (2, 1), (3, 1)]


def test_splits_keep_groups_and_rows(spark):
    labels, meta, rows = tables(spark)
    out = splits.grouped_splits(labels, meta).collect()
    assert len(out) == len(rows)
    by_group = {}
    for r in out:
        assert r["splitt"] in splits.PROPORTIONS
        by_group.setdefault(r["gruppe"], set()).add(r["splitt"])
    assert all(len(s) == 1 for s in by_group.values())
    assert {r["gruppe"] for r in out if r["dok_nr"] in (1, 2, 3)} == {"1"}
    assert splits.grouped_splits(labels.limit(0), meta).count() == 0
    assert splits.grouped_splits(labels, meta.limit(0)).count() == len(rows)


def greedy(units, proportions):
    """One unit after the other: the rarest outstanding label, its units by part, size and key, the split in most need with room."""
    plan = splits.Plan({x: sum(v.get(x, 0) for v in units.values()) for v in units.values() for x in v}, proportions)
    names, placed = list(proportions), {}
    while (label := plan.next_label()) is not None:
        for key in sorted((k for k in units if label in units[k] and k not in placed), key=lambda k: (-units[k][label], -sum(units[k].values()), k)):
            size = sum(units[key].values()) * plan.scale
            fits = [s for s in range(len(names)) if plan.room[s] >= size]
            s = max(fits, key=lambda s: (plan.need[label][s], plan.room[s])) if fits else max(range(len(names)), key=lambda s: plan.room[s])
            placed[key] = names[s]
            plan.room[s] -= size
            for x, n in units[key].items():
                plan.need[x][s] -= n * plan.scale
                plan.left[x] -= n
        plan.left[label] = 0
    return placed


def shares(units, placed):
    out = {}
    for k, v in units.items():
        for x, n in v.items():
            out[placed[k], x] = out.get((placed[k], x), 0) + n
    return out


def test_dealing_alike_units_together_is_the_greedy_order():
    rng = random.Random(4)
    for _ in range(60):
        proportions = dict(zip("abc", rng.choice([(0.8, 0.1, 0.1), (0.5, 0.3, 0.2), (1, 1, 1)])))
        # with one label equal units are alike in all, so the counts must agree exactly
        units = {i: {"x": rng.choice([1, 1, 1, 2, 3, 50])} for i in range(rng.randrange(1, 80))}
        placed = greedy(units, proportions)
        plan = splits.Plan({"x": sum(v["x"] for v in units.values())}, proportions)
        sizes = sorted({v["x"] for v in units.values()}, reverse=True)
        given = plan.place("x", [(n, n, sum(v["x"] == n for v in units.values())) for n in sizes])
        for part, _, counts in given:
            assert counts == [sum(placed[i] == s for i in units if units[i]["x"] == part) for s in proportions]


def test_splits_on_executors_meet_the_proportions_of_the_greedy_order(spark):
    rng = random.Random(6)
    units = {f"{i:04d}": {x: n for x, n in (("A", rng.randrange(0, 9)), ("B", rng.randrange(0, 3)), ("rare", int(rng.random() < 0.1)), ("hot", 900 if i == 5 else 1)) if n} for i in range(500)}
    groups = spark.createDataFrame([(k, v, sum(v.values())) for k, v in units.items()], "gruppe string, vector map<string,bigint>, size bigint")
    got = {r["gruppe"]: r["splitt"] for r in splits.stratified(groups, splits.PROPORTIONS).collect()}
    assert set(got) == set(units)
    one, other = shares(units, got), shares(units, greedy(units, splits.PROPORTIONS))
    for label in ("A", "B", "rare", "hot"):
        total = sum(v.get(label, 0) for v in units.values())
        for split in splits.PROPORTIONS:
            assert abs(one.get((split, label), 0) - other.get((split, label), 0)) <= max(6, 0.03 * total)


def test_very_many_labels(spark):
    rows = [(str(i), str(i % 25), "1", f"T{i % 30}", None, None, None, None) for i in range(300)]
    out = splits.grouped_splits(spark.createDataFrame(rows, LABELS), spark.createDataFrame([], META)).collect()
    assert len(out) == 300 and len({(r["dok_nr"], r["splitt"]) for r in out}) == 25
