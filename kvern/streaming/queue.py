"""Incremental processing: queue micro-batches, replace-on-write, resume, breaker, throughput, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.session import materialize

QUEUE_SCHEMA = "dokumentIdent struct<dokumentaar:int,dokumentnummer:int,embetenummer:int>, erElektroniskTinglyst boolean, rettsstiftelsestyper array<string>, filRevisjonId string"
ANSWER_SCHEMA = "pipeline_version string, pages array<struct<page:int,rotation:int>>, boxes array<struct<page:int,x:double,y:double,width:double,height:double,kilde:string,yolo_conf:double,paddle_rec_score:double>>"

# Consecutive failures that open the breaker, seconds it stays open.
FAILURES, COOLDOWN = 5, 30.0


def queue_items(documents: DataFrame) -> DataFrame:
    """doc_no, codes, electronic, usable of queue documents; one without identity is not usable but does not stop the others."""
    from kvern.functions.keys import doc_number

    ident = F.col("dokumentIdent")
    whole = F.coalesce(ident["dokumentaar"].isNotNull() & ident["dokumentnummer"].isNotNull() & ident["embetenummer"].isNotNull(), F.lit(False))
    return documents.select(doc_number(F.col("filRevisjonId")).alias("doc_no"), F.coalesce("rettsstiftelsestyper", F.array().cast("array<string>")).alias("codes"), F.coalesce("erElektroniskTinglyst", F.lit(False)).alias("electronic"), whole.alias("usable"))


def answer_boxes(answers: DataFrame, column: str = "answer") -> DataFrame:
    """doc_no and the boxes of a model answer in JSON, an object with boxes or a bare list of them."""
    box = ANSWER_SCHEMA.split("boxes ")[1]
    boxes = F.coalesce(F.from_json(column, ANSWER_SCHEMA)["boxes"], F.from_json(column, box))
    return answers.select("doc_no", F.explode(boxes).alias("b")).select("doc_no", "b.*")


def resumable(items: DataFrame, done: DataFrame, key: str = "doc_no") -> DataFrame:
    """Items not yet in the sink."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def retryable(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Manifest rows without a verdict, or with failed ones only."""
    good = verdicts.where("nullif(trim(svar), '') is not null and coalesce(feil, '') = ''").select("nr").distinct()
    return manifest.where("nr is not null").select("nr").distinct().join(good, "nr", "left_anti")


def replace_documents(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each document's boxes replace what the sink holds for it, also when there are none.

    The sink has a fixed number of folders by the hash of the document, whatever the number of documents; a batch rewrites
    the folders of its documents, so that a repeated batch leaves the same content. Batch columns: doc_no, boxes (an
    array, empty to clear; the last row of a document by its JSON text counts).
    """
    bucket = F.pmod(F.xxhash64("doc_no"), F.lit(buckets)).cast("int").alias("bucket")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.groupBy("doc_no").agg(F.max(F.to_json(F.struct("boxes"))).alias("value")).select("doc_no", "value", bucket))
        touched = rows.select("bucket").distinct()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.schema("doc_no bigint, value string, bucket int").parquet(path).join(touched, "bucket", "left_semi")
            rows = materialize(old.join(rows.select("doc_no"), "doc_no", "left_anti").select("doc_no", "value", "bucket").union(rows))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def stored_boxes(spark, path: str) -> DataFrame:
    """doc_no, value (JSON) of what replace_documents holds."""
    return spark.read.schema("doc_no bigint, value string, bucket int").parquet(path).select("doc_no", "value")


# Start and largest batch, successes before it grows, successes held back after an error.
LARGEST, SMALLEST, FIRST_GROWTH, GROWTH, HELD_BACK = 12, 1, 1, 2, -4


def batch_sizes(events: DataFrame, key: str = "worker", largest: int = LARGEST) -> DataFrame:
    """key, order, size: the batch size before each event of a worker's log (key, order, ok).

    A size halves on an error and from then on grows by one after GROWTH successes; before the first error it doubles after
    each success up to the largest.
    """
    kind = dict(events.dtypes)

    def run(k: tuple, log: pd.DataFrame) -> pd.DataFrame:
        size, good, doubling, out = largest, 0, True, []
        for ok in log.sort_values("order")["ok"]:
            if size < largest and good >= (FIRST_GROWTH if doubling else GROWTH):
                size, good = min(largest, size * 2 if doubling else size + 1), 0
            out.append(size)
            if ok:
                good += 1
            else:
                size, doubling, good = max(SMALLEST, size // 2), False, HELD_BACK
        return pd.DataFrame({key: k[0], "order": log.sort_values("order")["order"].to_numpy(), "size": out})

    return events.select(key, "order", "ok").groupBy(key).applyInPandas(run, f"{key} {kind[key]}, order {kind['order']}, size int")


def breaker_steps(state: tuple[int, float], events: list[tuple[float, bool]]) -> tuple[tuple[int, float], list[bool]]:
    """(new state, whether the breaker was open at each event); events are (seconds, success) in order; calls while it is open are not made."""
    failures, until = state
    opened = []
    for at, ok in events:
        is_open = at < until
        opened.append(is_open)
        if is_open:
            continue
        failures = 0 if ok else failures + 1
        if failures >= FAILURES:
            failures, until = 0, at + COOLDOWN
    return (failures, until), opened


def breaker_replay(events: DataFrame, key: str = "endpoint") -> DataFrame:
    """key, calls, failed, refused of each key's ordered event log (key, seconds, order, ok).

    A fold over a log depends on all before it; the log of one key is streamed in sorted batches, never held as a whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, sums = None, (0, 0.0), [0, 0, 0]
        for f in frames:
            for k, rows in f.groupby(key, sort=False):
                if k != current:
                    if current is not None:
                        yield pd.DataFrame([(current, *sums)], columns=[key, "calls", "failed", "refused"])
                    current, state, sums = k, (0, 0.0), [0, 0, 0]
                log = list(zip(rows["seconds"], rows["ok"]))
                state, opened = breaker_steps(state, log)
                sums = [sums[0] + len(log), sums[1] + sum(not o and not ok for o, (_, ok) in zip(opened, log)), sums[2] + sum(opened)]
        if current is not None:
            yield pd.DataFrame([(current, *sums)], columns=[key, "calls", "failed", "refused"])

    ordered = events.select(key, "seconds", "order", "ok").repartition(F.col(key)).sortWithinPartitions(key, "seconds", "order")
    return ordered.mapInPandas(run, f"{key} {dict(events.dtypes)[key]}, calls bigint, failed bigint, refused bigint")


def breaker_stream(events: DataFrame, key: str = "endpoint") -> DataFrame:
    """The same as a stream: key, calls, failed, refused so far for each key of a micro-batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, until, calls, failed, refused = state.get if state.exists else (0, 0.0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["seconds", "order"])
        (failures, until), opened = breaker_steps((failures, until), list(zip(rows["seconds"], rows["ok"])))
        calls, refused = calls + len(rows), refused + sum(opened)
        failed += sum(not o and not ok for o, ok in zip(opened, rows["ok"]))
        state.update((failures, until, calls, failed, refused))
        yield pd.DataFrame([(*k, calls, failed, refused)], columns=[key, "calls", "failed", "refused"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, calls bigint, failed bigint, refused bigint", "failures int, until double, calls bigint, failed bigint, refused bigint", "update", "NoTimeout")


def throughput(points: DataFrame, seconds: int = 60) -> DataFrame:
    """at, docs, per_second: the rate at each point against the newest point at least `seconds` old, else the oldest.

    points: worker, at (seconds, bigint), docs (running total). The rate is null where no time has passed.
    """
    order = Window.partitionBy("worker").orderBy("at")
    old = order.rangeBetween(Window.unboundedPreceding, -seconds)
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    base_at, base = F.coalesce(F.max("at").over(old), F.min("at").over(first)), F.coalesce(F.max("docs").over(old), F.min("docs").over(first))
    rows = points.groupBy("worker", "at").agg(F.max("docs").alias("docs"))
    return rows.withColumn("t0", base_at).withColumn("d0", base).select("worker", "at", "docs", F.round(F.when(F.col("at") > F.col("t0"), (F.col("docs") - F.col("d0")) / (F.col("at") - F.col("t0"))), 6).alias("per_second"))


# ----- event time

def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """The event time as a timestamp with time zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes", key: str = "event_type") -> DataFrame:
    """window_start, key, n, value: works on a stream and on a table alike."""
    timed = with_time(events)
    timed = timed.withWatermark("ts", late) if timed.isStreaming and late else timed
    return timed.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("window_start"), key, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes", key: str = "user_id") -> DataFrame:
    timed = with_time(events)
    timed = timed.withWatermark("ts", late) if timed.isStreaming and late else timed
    return timed.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; on a stream within the watermark."""
    timed = with_time(events)
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)
