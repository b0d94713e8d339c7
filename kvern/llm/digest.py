"""Problem 4: percentiles of very large columns from mergeable centroid digests.

A digest is a list of centroids (mean, weight) in order, clustered under a size
function of the quantile: a centroid holds what falls into one unit of
k(q) = delta / (2 pi) * asin(2 q - 1), so centroids are small at both ends. Each
input partition makes digests per group and day; digests merge by re-clustering
their centroids, first per group and day, later over any days. Estimates come from
interpolation between centroids (a centroid of one value is that value), and a second
pass over the values counts how many lie below and at each estimate, which certifies its
rank error. Groups with an estimate beyond the stated error are clustered again four
times as finely until all estimates are within it.

Defined results: sizes are absolute values of readable finite numbers; zero, NaN,
empty and other unreadable sizes are left out; a null or blank type is "(none)"; rows
exported again count again on the day they were loaded, so that days stay additive;
a null lastet is a day of its own. Equal values have a rank interval; an estimate
within it has error 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.functions.keys import number, upper_tag
from kvern.session import materialize

#: Stated bound of the rank error, as a part of the group's rows, and the delta that keeps well within it.
RANK_ERROR = 0.005
DELTA = 400
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Values and centroids that a task holds at once, over all groups.
BUFFER = 400_000


def clustered(group: np.ndarray, means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centroids (group, mean, weight) of many digests at once, in order: all of a group that falls into one unit of the size function is one."""
    if not len(group):
        return group, means, weights
    order = np.lexsort((means, group))
    group, means, weights = group[order], means[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    total = np.add.reduceat(weights, first)
    ends = np.cumsum(weights)
    before = ends[first] - weights[first]
    q = np.clip((ends - weights / 2 - before[which]) / total[which], 0.0, 1.0)
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(2 * q - 1))
    starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (unit[1:] != unit[:-1])]))
    w = np.add.reduceat(weights, starts)
    return group[starts], np.add.reduceat(means * weights, starts) / w, w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value of rank q: of a centroid of one value itself, else interpolated between middles, and to the extremes at the ends."""
    ends = np.cumsum(weights)
    at = min(int(np.searchsorted(ends, q * ends[-1] * (1 - 1e-12))), len(means) - 1)
    if weights[at] == 1:
        return float(means[at])
    middles = np.concatenate([[0.0], ends - weights / 2, [ends[-1]]])
    return float(np.interp(q * ends[-1], middles, np.concatenate([[low], means, [high]])))


def sizes(labels: DataFrame) -> DataFrame:
    """type, dag, felt (width or height), value of every usable size."""
    long = labels.select(
        F.coalesce(upper_tag(F.col("type")), F.lit("(none)")).alias("type"),
        F.to_date("lastet").alias("dag"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("felt"), F.abs(number(F.col(f))).alias("value")) for f in ("width", "height")])).alias("s"),
    )
    return long.select("type", "dag", "s.felt", "s.value").where("value > 0")


_DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"
_ARROW = [("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))]


class _Pool:
    """Centroids of many groups under construction, squeezed together whenever there are more than `most`."""

    def __init__(self, groups: list[str], delta: int, most: int = BUFFER):
        self.groups, self.delta, self.most = groups, delta, most
        self.clear()

    def clear(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.low, self.high = np.zeros(0), np.zeros(0)

    def numbered(self, batch: pa.RecordBatch) -> np.ndarray:
        """The group number of each row."""
        code, tables = np.zeros(batch.num_rows, np.int64), []
        for g in self.groups:
            d = batch.column(g).dictionary_encode(null_encoding="encode")
            code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
            tables.append(d.dictionary.to_pylist())
        seen, inverse = np.unique(code, return_inverse=True)
        ids = np.zeros(len(seen), np.int64)
        for i, c in enumerate(seen.tolist()):
            key = []
            for values in reversed(tables):
                c, at = divmod(c, len(values))
                key.append(values[at])
            ids[i] = self.keys.setdefault(tuple(reversed(key)), len(self.keys))
        more = len(self.keys) - len(self.low)
        self.low, self.high = np.append(self.low, np.full(more, np.inf)), np.append(self.high, np.full(more, -np.inf))
        return ids[inverse]

    def add(self, ids: np.ndarray, means: np.ndarray, weights: np.ndarray) -> None:
        self.parts.append((ids, means, weights))
        self.held += len(ids)

    def squeeze(self) -> None:
        self.parts = [clustered(*(np.concatenate(x) for x in zip(*self.parts)), self.delta)] if self.parts else []
        self.held = sum(len(p[0]) for p in self.parts)

    def rows(self, kinds: list[pa.DataType], but: int | None = None) -> Iterator[pa.RecordBatch]:
        """The digests of all groups, except of group number `but`, which stays."""
        self.squeeze()
        if not self.parts:
            return
        ids, means, weights = self.parts[0]
        keys = list(self.keys)
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        kept = None
        out = []
        for i, m, w in zip(ids[cuts].tolist(), np.split(means, cuts[1:]), np.split(weights, cuts[1:])):
            if i == but:
                kept = (keys[i], m, w, self.low[i], self.high[i])
            else:
                out.append((*keys[i], int(round(w.sum())), self.low[i], self.high[i], m, w))
        names = [*self.groups, *(n for n, _ in _ARROW)]
        types = [*kinds, *(t for _, t in _ARROW)]
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 1000]), types)], names)
        self.clear()
        if kept:
            self.keys[kept[0]] = 0
            self.low, self.high = np.array([kept[3]]), np.array([kept[4]])
            self.add(np.zeros(len(kept[1]), np.int64), kept[1], kept[2])


def _merge(digests: DataFrame, groups: list[str], delta: int) -> DataFrame:
    """One digest per combination of the groups: digests arrive sorted, and a task holds few centroids at once, however many there are of a group.

    The number of partitions is given, so that adaptive execution doesn't put all this Python work into one task.
    """
    kinds = dict(digests.dtypes)
    width = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, types = _Pool(groups, delta), None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(g).type for g in groups]
            ids = pool.numbered(batch)
            np.minimum.at(pool.low, ids, batch.column("low").to_numpy())
            np.maximum.at(pool.high, ids, batch.column("high").to_numpy())
            lists = batch.column("means")
            sizes_ = np.diff(lists.offsets.to_numpy())
            pool.add(np.repeat(ids, sizes_), lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy())
            if pool.held > pool.most:
                pool.squeeze()
                if pool.held > pool.most // 2:
                    yield from pool.rows(types, but=int(ids[-1]))
        if types:
            yield from pool.rows(types)

    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", " + _DIGEST
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    return digests.select(*groups, *names).repartition(width, *groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def day_digests(values: DataFrame, groups: list[str], delta: int = DELTA) -> DataFrame:
    """One digest per combination of the group columns (the day among them) of `value`: groups + n, low, high, means, weights."""
    kinds = dict(values.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, types = _Pool(groups, delta), None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(g).type for g in groups]
            ids, v = pool.numbered(batch), batch.column("value").to_numpy(zero_copy_only=False)
            np.minimum.at(pool.low, ids, v)
            np.maximum.at(pool.high, ids, v)
            pool.add(ids, v, np.ones(len(v)))
            if pool.held > pool.most:
                pool.squeeze()
                if pool.held > pool.most // 2:
                    yield from pool.rows(types)
        if types:
            yield from pool.rows(types)

    parts = values.select(*groups, "value").mapInArrow(partial, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", " + _DIGEST)
    return _merge(parts, groups, delta)


def combined(digests: DataFrame, groups: list[str], delta: int = DELTA) -> DataFrame:
    """Digests of any days, merged per group: groups + n, low, high, means, weights."""
    return _merge(digests, groups, delta)


def estimates(digests: DataFrame, groups: list[str], quantiles=QUANTILES) -> DataFrame:
    """groups, n, estimates: the estimate of each quantile in order."""
    kinds = dict(digests.dtypes)

    def read(frames):
        for f in frames:
            f["estimates"] = [[quantile(np.asarray(m), np.asarray(w), low, high, q) for q in quantiles] for m, w, low, high in zip(f["means"], f["weights"], f["low"], f["high"])]
            yield f[[*groups, "n", "estimates"]]

    return digests.mapInPandas(read, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n bigint, estimates array<double>")


def _certified(values: DataFrame, found: DataFrame, groups: list[str], quantiles) -> DataFrame:
    """groups, n, q, value, rank_error: the counting pass over the values; the estimates are a few values per group."""
    marks = [F.col("estimates")[i] for i in range(len(quantiles))]
    counted = values.join(found.select(*groups, "estimates"), groups).groupBy(groups).agg(
        *[F.count_if(F.col("value") < m).alias(f"below{i}") for i, m in enumerate(marks)],
        *[F.count_if(F.col("value") <= m).alias(f"upto{i}") for i, m in enumerate(marks)],
    )
    rows = found.join(counted, groups).select(
        *groups, "n",
        F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col("estimates")[i].alias("value"), F.col(f"below{i}").alias("below"), F.col(f"upto{i}").alias("upto")) for i, q in enumerate(quantiles)])).alias("r"),
    ).select(*groups, "n", "r.*")
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    return rows.select(*groups, "n", "q", "value", error.alias("rank_error"))


def percentiles(labels: DataFrame, quantiles=QUANTILES, delta: int = DELTA, bound: float = RANK_ERROR) -> DataFrame:
    """type, felt, n, q, value, rank_error, within: certified percentiles of width and height per type.

    rank_error is the exact distance of q from the ranks the value has among all rows,
    as a part of n; within says that it meets the bound.
    """
    values, groups = sizes(labels), ["type", "felt"]
    done = None
    todo = values
    for _ in range(6):
        found = materialize(estimates(combined(day_digests(todo, ["type", "felt", "dag"], delta), groups, delta), groups, quantiles))
        rows = materialize(_certified(todo, found, groups, quantiles))
        failed = rows.where(F.col("rank_error") > bound).select(groups).distinct()
        if failed.isEmpty():
            done = rows if done is None else done.union(rows)
            break
        good = rows.join(failed, groups, "left_anti")
        done = good if done is None else done.union(good)
        todo, delta = todo.join(failed, groups, "left_semi"), delta * 4
    else:
        done = done.union(rows.join(failed, groups, "left_semi"))
    return done.select(*groups, "n", "q", "value", "rank_error", (F.col("rank_error") <= bound).alias("within"))
