"""Problem 8: long exact spans shared between records.

The paragraphs are all windows of `span` characters of a text. Each gets the MinHash
of its character k-grams under one hash function, in a band of one row: identical
windows have identical k-gram sets and so the same minimum, which makes the recall
of the banding 1 for the spans asked for; neighbouring windows share their minimum,
so a text keeps about 2 / (span - k + 2) signatures a character. Texts whose
signatures collide are compared character by character along the offsets at which
they collide, and the runs found are exact. Texts held more than once are compared
once; clusters come from connected components.

A signature that stands in more than `crowd` different texts (a common phrase, or a
passage held very often) isn't paired: the windows around its occurrences are hashed
whole, and only texts with an equal window are linked, so a phrase shorter than the
span costs what its occurrences cost and no pairs.

Defined results: a null or empty text, or one shorter than `span`, shares nothing; a
document without id is left out; repeated rows of one id and text count as one
document. Compared as stored: code points, no normalisation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm.components import components
from kvern.llm.shingles import joined, mix, rolling, window_minima
from kvern.session import materialize

SPAN = 300
GRAM = 60
#: Signatures in more texts than this are resolved by whole windows.
CROWD = 32
#: Characters that one call of the NumPy code handles at once.
CHUNK = 1 << 18


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _class_of(text) -> Column:
    """The same digest in the JVM."""
    return F.expr(f"substring(unhex(sha2({text}, 256)), 1, 16)")


def signatures(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, cls, sig, pos: the window minima of each text of at least `span` characters; cls is its content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= CHUNK):
                    chars += len(texts[upto])
                    upto += 1
                which, pos, h = window_minima(texts[at:upto], gram, span)
                cls = pa.array([_digest(t) for t in texts[at:upto]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at + which]), cls.take(pa.array(which)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32))], ["doc_id", "cls", "sig", "pos"]
                )
                at = upto

    long = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where((F.length("text") >= span) & F.col("doc_id").isNotNull())
    return long.mapInArrow(run, "doc_id bigint, cls binary, sig bigint, pos int")


def _runs(a: np.ndarray, b: np.ndarray, offset: int, span: int) -> list[tuple[int, int, int]]:
    """Maximal runs of at least span equal characters with a at b's position plus offset: (start in a, start in b, length)."""
    x, y = max(0, offset), max(0, -offset)
    n = min(len(a) - x, len(b) - y)
    if n < span:
        return []
    unequal = np.flatnonzero(a[x : x + n] != b[y : y + n])
    edges = np.concatenate([[-1], unequal, [n]])
    lengths = np.diff(edges) - 1
    return [(int(edges[i]) + 1 + x, int(edges[i]) + 1 + y, int(lengths[i])) for i in np.flatnonzero(lengths >= span)]


def _crowded_windows(hits: DataFrame, texts: DataFrame, span: int, gram: int) -> DataFrame:
    """cls, st, win of every window of `span` characters around the given occurrences (sig, cls, pos) that another text has too.

    A window around a gram holds at least half of the other characters on one side of it. So an occurrence is looked at
    only where another text has the gram with that half before it, or with that half behind it: a phrase shorter than that
    costs two rows an occurrence, not one for each window.
    """
    half = (span - gram) // 2

    def beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for cls, text, places in zip(f.cls, f.text, f.places):
                h = rolling(joined([text])[0], gram + half).view(np.int64)
                p = np.asarray(places, np.int64)
                for side, starts in ((0, p - half), (1, p)):
                    good = (starts >= 0) & (starts < len(h))
                    out.append(pd.DataFrame({"cls": [cls] * int(good.sum()), "pos": p[good].astype(np.int32), "side": side, "h": h[starts[good]]}))
            yield pd.concat(out) if out else pd.DataFrame({"cls": [], "pos": [], "side": [], "h": []})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for cls, text, places in zip(f.cls, f.text, f.places):
                h = rolling(joined([text])[0], span).view(np.int64)
                p = np.asarray(places, np.int64)
                starts = np.unique((p[:, None] - np.arange(span - gram + 1)[None]).ravel())
                starts = starts[(starts >= 0) & (starts < len(h))]
                out.append(pd.DataFrame({"cls": [cls] * len(starts), "st": starts.astype(np.int32), "win": h[starts]}))
            yield pd.concat(out) if out else pd.DataFrame({"cls": [], "st": [], "win": []})

    places = hits.groupBy("cls").agg(F.collect_set("pos").alias("places"))
    sides = materialize(texts.join(places, "cls").select("cls", "text", "places").mapInPandas(beside, "cls binary, pos int, side int, h bigint"))
    elsewhere = sides.groupBy("side", "h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("side", "h")
    kept = sides.join(elsewhere, ["side", "h"], "left_semi").groupBy("cls").agg(F.collect_set("pos").alias("places"))
    windows = materialize(texts.join(kept, "cls").select("cls", "text", "places").mapInPandas(run, "cls binary, st int, win bigint"))
    shared = windows.groupBy("win").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("win")
    return materialize(windows.join(shared, "win", "left_semi").select("cls", "st", "win"))


def _couples(rows: DataFrame, key: str, member: str, salts: int = 16) -> DataFrame:
    """x, y of any two members of a key; one side is salted, so that the couples of a hot key come from many tasks."""
    x = rows.select(key, F.col(member).alias("x"), F.pmod(F.xxhash64(member), F.lit(salts)).cast("int").alias("salt"))
    y = rows.select(key, F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return x.join(y, [key, "salt"]).select("x", "y")


def shared_runs(documents: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, windows, members).

    runs: cls_a, cls_b, start_a, start_b, length for each pair of different texts and
    each maximal identical run at a signature of at most `crowd` texts. windows: cls, st,
    win of the shared windows at all other signatures. members: doc_id, cls of every text
    of at least span characters.
    """
    sigs = materialize(signatures(documents, span, gram))
    members = sigs.select("doc_id", "cls").distinct()
    once = sigs.select("sig", "cls", "pos").distinct()
    # signatures that stand in two different texts: the aggregates combine before their shuffles, however hot a signature is
    common = sigs.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("sig")
    hits = materialize(once.join(common, "sig", "left_semi"))
    size = hits.select("sig", "cls").distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    few = materialize(hits.join(size.where(F.col("n") <= crowd).select("sig"), "sig", "left_semi"))
    many = hits.join(size.where(F.col("n") > crowd).select("sig"), "sig", "left_semi")
    pairs = materialize(
        few.select("sig", F.col("cls").alias("cls_a"), F.col("pos").alias("pos_a"))
        .join(few.select("sig", F.col("cls").alias("cls_b"), F.col("pos").alias("pos_b")), "sig")
        .where("cls_a < cls_b")
        .groupBy("cls_a", "cls_b")
        .agg(F.collect_set(F.col("pos_a") - F.col("pos_b")).alias("offsets"))
    )
    needed = pairs.select(F.col("cls_a").alias("cls")).union(pairs.select(F.col("cls_b").alias("cls"))).union(many.select("cls")).distinct()
    holders = members.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    stored = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= span).withColumn("cls", _class_of("text"))
    texts = materialize(stored.join(holders, ["doc_id", "cls"]).dropDuplicates(["cls"]))
    windows = _crowded_windows(many, texts, span, gram)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for cls_a, cls_b, offsets, text_a, text_b in zip(batch.cls_a, batch.cls_b, batch.offsets, batch.text_a, batch.text_b):
                a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text_a, text_b))
                found += [(cls_a, cls_b, *run) for offset in offsets for run in _runs(a, b, int(offset), span)]
            yield pd.DataFrame(found, columns=["cls_a", "cls_b", "start_a", "start_b", "length"])

    runs = (
        pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
        .join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")
        .select("cls_a", "cls_b", "offsets", "text_a", "text_b")
        .mapInPandas(verify, "cls_a binary, cls_b binary, start_a int, start_b int, length int")
    )
    return runs, windows, members


def shared_pairs(documents: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_a < doc_b of each pair of documents with an identical run of at least span characters.

    The pairs are the wanted result here, so copies of a text are expanded at the very
    end, after all comparing was done once per text.
    """
    runs, windows, members = shared_runs(documents, span, gram, crowd)
    ends = windows.select("win", "cls").distinct()
    crowded = _couples(ends, "win", "cls").where("x < y").select(F.col("x").alias("cls_a"), F.col("y").alias("cls_b"))
    links = runs.select("cls_a", "cls_b").union(crowded.select("cls_a", "cls_b")).distinct()
    between = links.join(members.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("x")), "cls_a").join(members.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("y")), "cls_b").select("x", "y")
    held_twice = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    copies = members.join(held_twice, "cls", "left_semi")
    within = _couples(copies, "cls", "doc_id")
    every = between.union(within).where("x <> y")
    return every.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def _link_counts(windows: DataFrame, few: DataFrame) -> DataFrame:
    """cls, n_other: how many other texts each text shares a window with or is linked to in few (cls, other, both ways).

    Windows that the same texts hold are one set of texts; a set that lies within the set of the neighbouring window adds
    nothing and goes. Texts in the same sets are one profile, and only profiles are paired.
    """
    ends = windows.select("win", "cls").distinct()
    hashed = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"h{i}") for i in range(2)]
    alike = ["k", "lo", "h0", "h1"]
    prints = ends.groupBy("win").agg(F.count(F.lit(1)).alias("k"), F.min("cls").alias("lo"), *hashed)
    named = materialize(prints.join(prints.groupBy(*alike).agg(F.min("win").alias("id")), alike).select("win", "id", "k"))
    placed = windows.join(named, "win").select("cls", "st", "id", "k")
    by_start = Window.partitionBy("cls").orderBy("st")
    beside = placed.select("cls", "st", "id", "k", *[f(F.struct("st", "id")).over(by_start).alias(n) for n, f in (("before", F.lag), ("after", F.lead))])
    near = beside.select("cls", "st", "id", "k", F.explode(F.array("before", "after")).alias("b")).where((F.abs(F.col("b.st") - F.col("st")) == 1) & (F.col("b.id") != F.col("id")))
    within = near.select("id", "k", F.col("b.id").alias("by"), "cls").distinct().groupBy("id", "k", "by").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("id").distinct()
    sets = ends.join(named, "win").select("id", "cls").distinct().join(within, "id", "left_anti")
    of_text = materialize(sets.groupBy("cls").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    profiles = materialize(of_text.groupBy("ids").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("profile")))
    of_text = of_text.join(profiles, "ids").select("cls", "profile")
    held = profiles.select("profile", "n", F.explode("ids").alias("id"))
    met = materialize(held.select("id", F.col("profile").alias("a")).join(held.select("id", F.col("profile").alias("b"), "n"), "id").select("a", "b", "n").distinct())
    crowd = of_text.join(met.groupBy(F.col("a").alias("profile")).agg((F.sum("n") - 1).alias("n_crowd")), "profile").select("cls", "n_crowd")
    # links outside crowds that no crowd has
    sided = few.join(of_text.withColumnRenamed("profile", "a"), "cls", "left").join(of_text.select(F.col("cls").alias("other"), F.col("profile").alias("b")), "other", "left")
    alone = sided.join(met.select("a", "b"), ["a", "b"], "left_anti").groupBy("cls").agg(F.count(F.lit(1)).alias("n_few"))
    return alone.join(crowd, "cls", "full").select("cls", (F.coalesce("n_few", F.lit(0)) + F.coalesce("n_crowd", F.lit(0))).alias("n_other"))


def shared_portion(documents: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per document that shares a span: doc_id, n_chars, shared_chars, shared_part, n_links, gruppe, keep.

    n_links counts the different texts it shares a span with, and one more if its own
    text is held more than once. gruppe is the smallest document of its cluster, whose
    keep is true.
    """
    runs, windows, members = shared_runs(documents, span, gram, crowd)
    runs = materialize(runs)
    held = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_held"), F.min("doc_id").alias("first"))
    length = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n_chars")).where(F.col("n_chars") >= span).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    sides = runs.select(F.col("cls_a").alias("cls"), F.col("start_a").alias("st"), F.col("length"), F.col("cls_b").alias("other")).union(
        runs.select(F.col("cls_b").alias("cls"), F.col("start_b").alias("st"), F.col("length"), F.col("cls_a").alias("other"))
    )
    # sweep the runs of a text by start; what reaches beyond all earlier ends is new coverage
    spans = sides.select("cls", "st", "length").union(windows.select("cls", "st", F.lit(span))).groupBy("cls", "st").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy("cls").orderBy("st").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.withColumn("seen", F.coalesce(F.max(F.col("st") + F.col("length")).over(earlier), F.lit(0)))
        .groupBy("cls")
        .agg(F.sum(F.greatest(F.lit(0), F.col("st") + F.col("length") - F.greatest("seen", "st"))).alias("covered"))
    )
    crowds = windows.select("win", "cls").distinct().groupBy("win").agg(F.count(F.lit(1)).alias("k"), F.min("cls").alias("lo"))
    links = _link_counts(windows, sides.select("cls", "other").distinct())
    # a crowd is linked as a star
    stars = windows.select("win", "cls").distinct().join(crowds, "win").where("cls <> lo").select(F.col("lo").alias("cls_a"), F.col("cls").alias("cls_b"))
    firsts = held.select("cls", "first")
    edges = (
        runs.select("cls_a", "cls_b").union(stars).distinct()
        .join(firsts.select(F.col("cls").alias("cls_a"), F.col("first").alias("a")), "cls_a")
        .join(firsts.select(F.col("cls").alias("cls_b"), F.col("first").alias("b")), "cls_b")
        .select("a", "b")
    )
    roots = components(edges).select(F.col("node").alias("first"), "root")
    per_text = (
        held.join(covered, "cls", "left").join(links, "cls", "left").where("n_held > 1 or covered > 0")
        .join(roots, "first", "left")
        .select("cls", "n_held", "covered", "n_other", F.least(F.coalesce("root", "first"), "first").alias("gruppe"))
    )
    whole = F.when(F.col("n_held") > 1, F.col("n_chars")).otherwise(F.col("covered"))
    return (
        members.join(per_text, "cls").join(length, "doc_id")
        .select(
            "doc_id", "n_chars", whole.cast("bigint").alias("shared_chars"), (whole / F.col("n_chars")).alias("shared_part"),
            (F.coalesce("n_other", F.lit(0)) + (F.col("n_held") > 1).cast("int")).cast("bigint").alias("n_links"), "gruppe", (F.col("doc_id") == F.col("gruppe")).alias("keep"),
        )
    )


# ----- the plain paragraph method, kept for its figures

_PARAGRAPH = re.compile(r"(?<=[.:;])\s*\n\s*|\n\s*\n")


def paragraph_pairs(documents: DataFrame, bands: int = 20, rows: int = 5, words: int = 5, least: float = 0.8, shortest: int = SPAN) -> DataFrame:
    """doc_a < doc_b of documents with paragraphs of at least `least` word-shingle similarity, by MinHash banding.

    A paragraph ends at a line break after a sentence, or at a blank line. Bands are joined, colliding paragraphs are
    verified by exact Jaccard. Paragraphs shorter than the span asked for can't hold one and are left out.
    """
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def shingles(text: str) -> np.ndarray:
        ws = re.findall(r"\w+", text.lower())
        grams = [" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))]
        return np.unique(np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in grams], np.uint64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"], f["text"]):
                for i, p in enumerate(x for x in _PARAGRAPH.split(text) if len(x) >= shortest):
                    s = shingles(p)
                    signature = mix(s[:, None] ^ seeds[None]).min(axis=0).reshape(bands, rows)
                    keys = [int(hash(tuple(b.tolist()))) for b in signature]
                    out.append((doc, i, s.view(np.int64), keys))
            yield pd.DataFrame(out, columns=["doc_id", "i", "shingles", "bands"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    paragraphs = materialize(texts.mapInPandas(run, "doc_id bigint, i int, shingles array<bigint>, bands array<bigint>"))
    banded = paragraphs.select("doc_id", "i", F.posexplode("bands").alias("band", "key"))
    a, b = (banded.select(F.col("doc_id").alias(f"doc_{x}"), F.col("i").alias(f"i_{x}"), "band", "key") for x in "ab")
    near = a.join(b, ["band", "key"]).where("doc_a < doc_b").select("doc_a", "i_a", "doc_b", "i_b").distinct()
    sa, sb = (paragraphs.select(F.col("doc_id").alias(f"doc_{x}"), F.col("i").alias(f"i_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    both = near.join(sa, ["doc_a", "i_a"]).join(sb, ["doc_b", "i_b"]).where(shared / (F.size("s_a") + F.size("s_b") - shared) >= least)
    return both.select("doc_a", "doc_b").distinct()
