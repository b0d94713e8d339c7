import random

from kvern.llm import overlaps

LABELS = "id string, fil_revisjon_id string, sidetall string, x string, y string, width string, height string, n string, rep string"
SPLITS = "fil string, splitt string, uttrekk string, n string"
MANIFEST = "nr bigint, fil string, doc string"


def data():
    rng = random.Random(8)
    rows, boxes = [], {}

    def add(doc, bs):
        boxes[doc] = set(bs)
        for p, x, y, w, h in bs:
            flip = rng.random() < 0.3
            rows.append(("i", rng.choice([f"{doc}", f" {doc}", f"{doc}.0", f"00{doc}.pdf"]), rng.choice([f"{p}", f"{p}.0", f" {p}"]), f"{x + w if flip else x:.2f}", f"{y:.2f}", f"{-w if flip else w:.2f}".replace(".", rng.choice(".,")), f"{h:.4e}", "n", "r"))

    def fresh(n):
        return list({(rng.randrange(1, 3), round(rng.uniform(0, 60), 2), round(rng.uniform(0, 60), 2), round(rng.uniform(8, 14), 2), 8.0) for _ in range(n)})

    for doc in range(1, 60):
        add(doc, fresh(rng.choice([3, 5, 6, 9, 20])))
    for k, doc in enumerate(range(101, 130)):
        base = list(boxes[1 + k])
        keep = base[: max(1, int(len(base) * rng.choice([0.5, 0.6, 0.65, 0.8, 1.0]) + 0.5))]
        jitter = rng.choice([0.0, 1.9, 2.0, 2.5])
        add(doc, [(p, round(x + jitter, 2), round(y - jitter, 2), w, h) for p, x, y, w, h in keep] + fresh(rng.choice([0, 1, 3])))
    splits = [(f"{d}.pdf", rng.choice(["train", "TRAIN ", "train", "val", "test "]), "u1", "n") for d in [*range(1, 60), *range(101, 130)]]
    splits += [("skann/3_side1.png", "val", None, "n"), ("3", "train", "u2", "n"), (None, "val", None, None), ("x", "test", "", ""), ("9", "annet", "u", "n")]
    manifest = [(1, "uttrekk_1/105.PDF", "d"), (2, "777.pdf", "d"), (3, None, None)]
    rows += rows[:50] + [("i", "1", None, "1", "1", "1", "1", "n", "r"), ("i", None, "1", "1", "1", "1", "1", "n", "r"), ("i", "1", "1", "5", "5", "0", "3", "n", "r"), ("i", "1", "1", "5", "5", "NaN", "", "n", "r")]
    return rows, splits, manifest, boxes


def brute(splits, manifest, boxes):
    roles = {}
    for fil, s, *_ in splits:
        if fil and s.strip().lower() in ("train", "val", "test"):
            digits = "".join(c for c in fil.split("/")[-1].split("_")[0].split(".")[0])
            if digits.isdigit():
                roles.setdefault(s.strip().lower(), set()).add(int(digits))
    roles["pilot"] = {105, 777}
    close = lambda a, b: a[0] == b[0] and all(abs(u - v) <= 2 + 1e-6 for u, v in zip(a[1:], b[1:]))
    found = set()
    for split in ("val", "test", "pilot"):
        for e in roles.get(split, ()):
            for t in roles["train"]:
                A, B = boxes.get(e, set()), boxes.get(t, set())
                if e == t or len(A) >= 5 and len(B) >= 5 and sum(any(close(a, b) for b in B) for a in A) >= 0.6 * len(A) - 1e-9 and sum(any(close(a, b) for a in A) for b in B) >= 0.6 * len(B) - 1e-9:
                    found.add((min(e, t), max(e, t), split))
    return found


def test_found_matches_brute_force(spark):
    rows, splits, manifest, boxes = data()
    args = spark.createDataFrame(rows, LABELS), spark.createDataFrame(splits, SPLITS), spark.createDataFrame(manifest, MANIFEST)
    want = brute(splits, manifest, boxes)
    assert any(a != b for a, b, _ in want) and any(a == b for a, b, _ in want)
    assert {tuple(r) for r in overlaps.found_pairs(*args).collect()} == want
    report = overlaps.overlap_report(*args).collect()
    assert {r["splitt"] for r in report} == {"val", "test", "pilot"}


def test_empty(spark):
    rows, splits, manifest, _ = data()
    empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], SPLITS), spark.createDataFrame([], MANIFEST)
    assert overlaps.found_pairs(*empty).count() == 0
    assert overlaps.found_pairs(spark.createDataFrame(rows, LABELS), empty[1], empty[2]).count() == 0


def test_the_plain_suffix_array_finds_runs_of_boxes(spark):
    rows = [(d, 1, 10.0 * k + (0.1 if d == 2 else 0.0) + (1 if d == 3 else 0) * 500, 40.0, 20.0, 8.0) for d in (1, 2, 3) for k in range(6)]
    boxes = spark.createDataFrame(rows, "doc bigint, page int, x double, y double, w double, h double")
    one, two = spark.createDataFrame([(1,)], "doc bigint"), spark.createDataFrame([(2,), (3,)], "doc bigint")
    assert {tuple(r) for r in overlaps.suffix_array_pairs(boxes, one, two, 2).collect()} == {(1, 2, 6)}
