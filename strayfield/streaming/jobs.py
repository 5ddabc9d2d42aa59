"""Streaming forms of ingest, arrivals, bursts, alerts and enrolment. Each gives what its batch form gives over the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.versions import Store

STRAYS, HOT_TICKS = 3, 5


def arrivals(stream: DataFrame) -> DataFrame:
    """Photo-bearing records as they come."""
    return stream.where(F.size("photos") > 0).select("canonical_id", "species", "last_seen")


def ticks(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Totals and strays per source and day; rows later than ``late`` are left to the upsert path."""
    d = stream.withColumn("at", F.col("last_seen").cast("timestamp")).withWatermark("at", late)
    g = d.groupBy("source_name", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("intake_type").isin("stray", "found_report")).alias("strays"))
    return g.select("source_name", F.col("w.start").alias("tick"), "total", "strays")


def enrolments(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """A task per photo of records that haven't departed; a photo that comes again within the watermark isn't enrolled again."""
    d = stream.where("availability <> 'departed'").withColumn("at", F.col("last_seen").cast("timestamp")).withWatermark("at", within)
    return d.select("canonical_id", "at", F.explode("photos").alias("url")).dropDuplicatesWithinWatermark(["canonical_id", "url"]).select("canonical_id", "url")


def bursts(ticks: DataFrame) -> DataFrame:
    """From (source_name, tick, strays): ``hot``, the ticks that a source stays hot. A tick of enough strays makes five, every other takes one away.

    The batch form: five less the ticks since the last burst.
    """
    w = Window.partitionBy("source_name").orderBy("tick")
    d = ticks.withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("strays") >= STRAYS, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("hot", F.coalesce(F.greatest(F.lit(0), HOT_TICKS - (F.col("_n") - last)), F.lit(0)).cast("int")).drop("_n")


def burst_stream(ticks: DataFrame) -> DataFrame:
    """The streaming form of ``bursts``: one counter of state per source. Ticks of a source must come in order."""

    def step(key, frames, state):
        hot = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("tick")
        out = []
        for tick, strays in zip(rows["tick"], rows["strays"], strict=True):
            hot = HOT_TICKS if strays >= STRAYS else max(0, hot - 1)
            out.append((key[0], tick, strays, hot))
        state.update((hot,))
        yield pd.DataFrame(out, columns=["source_name", "tick", "strays", "hot"])

    return ticks.groupBy("source_name").applyInPandasWithState(step, "source_name string, tick int, strays bigint, hot int", "hot int", "append", "NoTimeout")


def alert_sink(folder: str, reports: DataFrame, threshold: float = 0.8):
    """A foreachBatch sink: strong candidates of active reports, once each; what the ledger in ``folder`` has isn't sent again."""
    from ..operators.reports import new_alerts

    schema = "report_id string, candidate_id string, outcome string"

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(folder)
        strong = batch.where(F.col("score") >= threshold).select("report_id", "candidate_id").join(reports.where("status = 'active'").select("report_id"), "report_id", "left_semi")
        fresh = new_alerts(strong, spark.read.schema(schema).parquet(folder))
        fresh.withColumn("outcome", F.lit("Sent")).select("report_id", "candidate_id", "outcome").write.mode("append").parquet(folder)

    return sink


def match_sink(folder: str, photos: DataFrame, reports: DataFrame, k: int = 10, threshold: float = 0.8):
    """A foreachBatch sink for new gallery vectors (vec_id, canonical_id, species, embedding): the ``k`` nearest animals of a batch to each photo (report_id, species,
    embedding) of an active report become alerts, once each, in the ledger in ``folder``."""
    from ..operators import vectors

    send = alert_sink(folder, reports, threshold)

    def sink(batch: DataFrame, epoch: int) -> None:
        hits = vectors.knn_animals(batch, photos.select(F.col("report_id").alias("query_id"), "species", "embedding"), k)
        send(hits.select(F.col("query_id").alias("report_id"), F.col("canonical_id").alias("candidate_id"), F.col("similarity").alias("score")), epoch)

    return sink


def ingest_store(spark: SparkSession, folder: str) -> Store:
    """The store that ``ingest_sink(folder)`` keeps."""
    kind = "key string, species string, availability string, event_id bigint, created_at timestamp, absent_count int, source_name string, source_animal_id string, canonical_id string"
    return Store(spark, f"{folder}/store", kind)


def ingest_sink(folder: str):
    """A foreachBatch sink that keeps the canonical store: batch N makes version N + 1 of ``ingest_store(folder)`` and ``folder/events/epoch=N``, what it changed.

    A batch reads and rewrites the buckets of its own animals alone. One that runs again starts from the version before it, so a retry changes nothing.
    """
    from ..operators.store import by_animal, change_events, last_of_batch

    def sink(batch: DataFrame, epoch: int) -> None:
        held = ingest_store(batch.sparkSession, folder)
        batch = batch.withColumn("key", F.concat_ws("/", "source_name", "source_animal_id")).persist()
        buckets = held.touched(by_animal(batch)[0])
        events = change_events(batch, held.read(epoch, buckets).select("source_name", "source_animal_id", "canonical_id"))
        changed = events.select("canonical_id", F.col("resolved_id"), "kind", "source_name", "source_animal_id", "event_id")
        changed.write.mode("overwrite").parquet(f"{folder}/events/epoch={epoch}")
        first = Window.partitionBy("source_name", "source_animal_id")
        ids = by_animal(events)[0].withColumn("_id", F.min_by("resolved_id", "event_id").over(first))
        last = last_of_batch(ids).select("key", "species", "availability", "event_id", F.col("last_seen").cast("timestamp").alias("created_at"), F.lit(0).alias("absent_count"), "source_name", "source_animal_id", F.col("_id").alias("canonical_id"))
        held.apply(last, epoch + 1, buckets)
        batch.unpersist()

    return sink
