"""Streams whose result equals the batch operators (STR-01..04)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

def first_seen_batch(arrivals: DataFrame, batch_id: int, path: str, keys: list[str], at: str, buckets: int) -> None:
    """STR-03 as a foreachBatch sink: keys not in the table yet are added with their first arrival, and never forgotten.

    The table is partitioned by a hash bucket of the key and the batch. A batch reads the buckets that its keys fall in,
    without what it has written itself, so that a replayed batch finds and writes the same rows again.
    """
    spark = arrivals.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    news = arrivals.groupBy(*keys).agg(F.min(at).alias("first_at")).withColumns({"bucket": bucket, "batch": F.lit(batch_id).cast("long")})
    held = first_seen_table(spark, path, news.schema)
    # At most `buckets` numbers, so that the table's other partitions are not read.
    touched = [r["bucket"] for r in news.select("bucket").distinct().collect()]
    known = held.where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id)).select(*keys, "bucket")
    news = news.join(known, [*keys, "bucket"], "left_anti")
    news.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def first_seen_table(spark, path: str, schema) -> DataFrame:
    """What `first_seen_batch` has written, or no rows."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def counters_stream(arrivals: DataFrame, at: str, delay: str, period: str, by: str) -> DataFrame:
    """STR-04: counts per period and `by`, appended once the period is over."""
    counted = arrivals.withWatermark(at, delay).groupBy(F.window(at, period), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("period"), by, "n")


def counters_batch(rows: DataFrame, at: str, period: str, by: str) -> DataFrame:
    counted = rows.groupBy(F.window(at, period), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("period"), by, "n")


END = "end"
LIFE = "source_key string, bucket int, external_id string, first_at long, last_at long, closed_at long"
#: The state of a listing needs a store that keeps maps.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ListingLives(StatefulProcessor):
    """State of a source's listings in one bucket: first and last sighting and closing of each; -1 stands for none.

    An end row says that a fetch of the source is complete: listings last seen before it are closed. A failed fetch has no
    end row and closes nothing. Only listings that change are given out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lives = handle.getMapState("lives", "external_id string", "first_at long, last_at long, closed_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen: dict[int, set] = {}
        ends = set()
        for batch in rows:  # what is held is this bucket's part of one micro-batch
            for at, kind, name in zip(batch["at"], batch["kind"], batch["external_id"]):
                if kind == END:
                    ends.add(int(at))
                else:
                    seen.setdefault(int(at), set()).add(name)
        # The bucket's state is read once for a micro-batch; open listings are then held by the day they were last seen.
        lives = {k[0]: tuple(v) for k, v in self.lives.iterator()}
        open_at: dict[int, set] = {}
        for name, (_, last, closed) in lives.items():
            if closed < 0:
                open_at.setdefault(last, set()).add(name)
        changed = {}
        for at in sorted(ends | seen.keys()):
            for name in seen.get(at, ()):
                first, last, _ = lives.get(name, (at, at, -1))
                open_at.get(last, set()).discard(name)
                lives[name] = changed[name] = (min(first, at), max(last, at), -1)
                open_at.setdefault(max(last, at), set()).add(name)
            if at in ends:
                for day in [d for d in open_at if d < at]:
                    for name in open_at.pop(day):
                        lives[name] = changed[name] = (*lives[name][:2], at)
        for name, life in changed.items():
            self.lives.updateValue((name,), life)
        values = list(changed.items())
        yield pd.DataFrame(
            {
                "source_key": [key[0]] * len(values), "bucket": [key[1]] * len(values), "external_id": [n for n, _ in values],
                **{c: [v[i] for _, v in values] for i, c in enumerate(("first_at", "last_at", "closed_at"))},
            }
        ).astype({"bucket": "int32"})

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """STR-02: one row per change of a listing's state. events: as `snapshots` gives them.

    State is kept by source and bucket, so that a source with most of the listings is many keys.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    return events.groupBy("source_key", "bucket").transformWithStateInPandas(
        statefulProcessor=ListingLives(), outputStructType=LIFE, outputMode="Update", timeMode="None"
    )


def snapshots(sightings: DataFrame, fetches: DataFrame, buckets: int) -> DataFrame:
    """Complete fetches as rows: source_key, bucket, external_id, at, kind (seen, or end once for each bucket).

    sightings: source_key, external_id, at; fetches: source_key, at, status. What a failed fetch has seen is left out.
    """
    done = fetches.where("status = 'success'").select("source_key", "at").distinct()
    seen = sightings.select("source_key", "external_id", "at").distinct().join(done, ["source_key", "at"], "left_semi")
    bucket = F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int")
    columns = ("source_key", "bucket", "external_id", "at", "kind")
    ends = done.select("source_key", "at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    ends = ends.withColumns({"external_id": F.lit(None).cast("string"), "kind": F.lit(END)})
    return seen.withColumns({"bucket": bucket, "kind": F.lit("seen")}).select(*columns).unionByName(ends.select(*columns))


def latest_states(updates: DataFrame) -> DataFrame:
    """The last update of each listing, over the batches a sink has written."""
    row = F.struct("first_at", "last_at", "closed_at")
    return updates.groupBy("source_key", "external_id").agg(F.max_by(row, "batch").alias("s")).select(
        "source_key", "external_id", "s.*"
    )


def mark_stale_batch(changes: DataFrame, batch_id: int, path: str) -> None:
    """STR-01 as a foreachBatch sink: reasons per job, written under the batch id.

    A replayed batch overwrites its own folder, so a reason is never appended twice.
    """
    reasons = changes.groupBy("job_id", "reason").agg(F.min("at").alias("since"))
    reasons.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stale_jobs(marks: DataFrame) -> DataFrame:
    """Current marks over all batches: each reason once, the earliest time it held."""
    return marks.groupBy("job_id", "reason").agg(F.min("since").alias("since"))


def run_available(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Drain a stream into one folder per batch and read the result back.

    A batch that is run again writes its own folder again, so nothing is counted twice.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/out").schema(
        stream.schema.add("batch", "long")
    ).parquet(f"{folder}/out")
