"""Problem 7: a mixture of sources with target shares of the tokens.

Every text is counted in tokens of a public tokenizer, and texts held more than once
are one text of their smallest document. The texts get hash-random keys and are
range-sorted by source and key; the token counts per range partition and source give
each partition its offset, so that prefix sums need no single sorted task. The total
is the largest at which every source with documents can give its share without a
text beyond its cap, or the total asked for if that is smaller; each source gives
whole epochs and then the texts whose prefix sum stays within what is left.

Defined results: source names are compared trimmed, in lower case and with - as _;
documents of a source without a target (or with a null one) are left out; a target
of 0 or less, or a cap below 1, gives nothing; the shares of targets with documents
are scaled to 1; null and empty texts have 0 tokens and aren't used; several target
rows of a source count as one with their summed share and smallest cap.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.session import materialize

VOCABULARY = os.environ.get("KVERN_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the vocabulary (a published pattern).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of PLAIN characters only, where \w and \d are letters, digits and the underscore.
_PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_counters: dict = {}


class TokenCounter(dict):
    """Counts the tokens of texts; keeps the counts of up to `most` different pieces, others are counted anew each time."""

    def __init__(self, vocabulary: str, most: int = 300_000):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.encode = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < self.most:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if _NOT_PLAIN.search(text):
            return len(self.encode(text))
        return sum(map(self.__getitem__, _PLAIN_SPLIT.findall(text)))


def counter(vocabulary: str) -> TokenCounter:
    """The counter of a vocabulary file of ranks, once per process."""
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def source_name(c):
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "-", "_"), F.lit(""))


def token_sizes(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, cls (content hash) of the documents of the given sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(count, texts)), pa.int64()), pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())],
                ["doc_id", "source", "n_tokens", "cls"],
            )

    wanted = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0) & F.col("source").isin(sources))
    return wanted.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, cls binary")


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source is to give: its scaled share of the largest total that no cap forbids, or of `total`."""
    usable = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] >= 1}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    most = min(available[s] * cap * whole / share for s, (share, cap) in usable.items())
    most = most if total is None else min(most, total)
    return {s: min(int(most * share / whole + 1e-6), available[s] * cap) for s, (share, cap) in usable.items()}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict, dict]:
    """(mixture, targets, budgets). Mixture: doc_id, source, n_tokens, n_copies, one row per text that is used."""
    spark = documents.sparkSession
    aims: dict[str, tuple[float, int]] = {}
    named = targets.select(source_name(F.col("source")).alias("source"), F.col("maal_andel").cast("double"), F.col("maks_gjentak").cast("int")).where("source is not null and maal_andel > 0 and maal_andel < double('inf') and maks_gjentak >= 1")
    for source, share, cap in named.collect():
        old = aims.get(source, (0.0, cap))
        aims[source] = (old[0] + share, min(old[1], cap))
    empty = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, n_copies int")
    if not aims:
        return empty, aims, {}
    texts = token_sizes(documents, sorted(aims), vocabulary).where("n_tokens > 0")
    once = texts.groupBy("cls").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("first")).select("first.*")
    keyed = once.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    ranged = materialize(keyed.repartitionByRange("source", "key", "doc_id").withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect()
    available: dict[str, int] = {}
    offsets = []
    for source, part, n in sorted((r["source"], r["part"], r["n"]) for r in per_part):
        offsets.append((source, part, available.get(source, 0)))
        available[source] = available.get(source, 0) + n
    give = budgets(available, aims, total)
    if not give:
        return empty, aims, give
    plan = spark.createDataFrame([(s, p, o, give[s] // available[s], give[s] % available[s]) for s, p, o in offsets if s in give], "source string, part int, before bigint, epochs bigint, rest bigint")
    running = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    used = ranged.join(plan, ["source", "part"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(running))
    copies = (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int")
    return used.select("doc_id", "source", "n_tokens", copies.alias("n_copies")).where("n_copies > 0"), aims, give


def mixed_records(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixture(documents, targets)[0]


def mixed_shares(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, maal_andel, maks_gjentak, budget, tokens, share, most_copies of each target; share is what was reached."""
    mix, aims, give = mixture(documents, targets, total)
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(s, a, c, give.get(s, 0)) for s, (a, c) in sorted(aims.items())], "source string, maal_andel double, maks_gjentak int, budget bigint")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.max("n_copies").alias("most_copies"))
    rows = wanted.join(got, "source", "left").na.fill(0, ["tokens", "most_copies"])
    # one row per source of the targets: a window over so few rows is no bottleneck
    return rows.withColumn("share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
