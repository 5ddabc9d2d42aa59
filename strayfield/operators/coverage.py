"""Coverage of sources and of the map, and statistics of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import CELL, cell, cell_centre

#: Metros without a feed, with their centres.
GAPS = [("Los Angeles, CA", 34.05, -118.25), ("New York, NY", 40.71, -74.01), ("Chicago, IL", 41.85, -87.65), ("Houston, TX", 29.76, -95.37), ("Phoenix, AZ", 33.45, -112.07)]
RECENT_SECONDS, STALE_TIMES = 4 * 3600, 3


def seconds_between(now: Column, then: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))


def geo_rollup(records: DataFrame, least: int = 1) -> DataFrame:
    """Per half-degree cell: records, strays, sources, newest; cells of fewer than ``least`` records are left out. One hash aggregate."""
    d = records.where("lat is not null and lon is not null").withColumns({"lat_idx": cell(F.col("lat")), "lon_idx": cell(F.col("lon"))})
    g = d.groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("records"), F.count_if(F.col("intake_type").isin("stray", "found_report")).alias("strays"), F.countDistinct("source_name").alias("sources"), F.max("last_seen").alias("newest"))
    return g.where(F.col("records") >= least).withColumns({"centre_lat": cell_centre(F.col("lat_idx")), "centre_lon": cell_centre(F.col("lon_idx"))})


def geocoding_tally(records: DataFrame) -> DataFrame:
    """How many records have a cell, and how many have none for want of coordinates."""
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return records.agg(F.count_if(here).alias("geocoded"), F.count_if(~here).alias("ungeocoded"))


def coverage_holes(cells: DataFrame, seeds: DataFrame, least: int = 1) -> DataFrame:
    """(name, lat_idx, lon_idx, missed): seeds (name, lat, lon) whose cell no source covers, and cells without a name of at least ``least`` records without
    a source. What is missed is estimated by the records of the nine cells around."""
    loose = cells.where((F.col("records") >= least) & (F.col("sources") == 0)).join(seeds.select(cell(F.col("lat")).alias("lat_idx"), cell(F.col("lon")).alias("lon_idx")), ["lat_idx", "lon_idx"], "left_anti")
    s = seeds.withColumns({"lat_idx": cell(F.col("lat")), "lon_idx": cell(F.col("lon"))})
    open_ = s.join(cells.where("sources > 0").select("lat_idx", "lon_idx"), ["lat_idx", "lon_idx"], "left_anti")
    open_ = open_.select("name", "lat_idx", "lon_idx").unionByName(loose.select(F.lit(None).cast("string").alias("name"), "lat_idx", "lon_idx"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = open_.withColumn("_s", F.explode(steps)).select("name", F.col("lat_idx").alias("_a"), F.col("lon_idx").alias("_b"), (F.col("lat_idx") + F.col("_s.i")).alias("lat_idx"), (F.col("lon_idx") + F.col("_s.j")).alias("lon_idx"))
    return near.join(cells.select("lat_idx", "lon_idx", "records"), ["lat_idx", "lon_idx"], "left").groupBy("name", F.col("_a").alias("lat_idx"), F.col("_b").alias("lon_idx")).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("missed"))


def ingest_stats(records: DataFrame, now: Column) -> DataFrame:
    """All counts of the store in one pass. Departed records count as fresh too, but never as stale."""
    age = seconds_between(now, F.col("last_confirmed"))
    here = F.col("availability") != "departed"
    return records.agg(
        F.count("*").alias("total"), F.count_if(F.col("species") == "dog").alias("dogs"), F.count_if(F.col("species") == "cat").alias("cats"), F.count_if(~here).alias("departed"),
        F.count_if(age <= 3600).alias("fresh_1h"), F.count_if(age <= 86400).alias("fresh_24h"), F.count_if(here & (age.isNull() | (age > 86400))).alias("stale"),
    )


#: The metros of sources by name.
METROS = {
    "austin": "Austin, TX",
    "dallas": "Dallas, TX",
    "sonoma": "Sonoma County, CA",
    "long_beach": "Long Beach, CA",
    "petfbi": "National (PetFBI)",
    "rescuegroups": "National (RescueGroups)",
}


def metro_label(source: Column) -> Column:
    """A source's metro; of an unlisted source its name, with spaces and a capital."""
    words = F.translate(source, "_", " ")
    other = F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1000))
    return F.coalesce(*[F.when(source == s, F.lit(m)) for s, m in METROS.items()], other)


def source_coverage(catalog: DataFrame, links: DataFrame, records: DataFrame, cursors: DataFrame, now: Column) -> DataFrame:
    """Per registered source (source_name, cadence): metro, records, strays, last success and status; sources without records are silent.

    ``links`` (source_name, canonical_id, link_seen) say which records are a source's; the last success is its cursor (source_name, cursor),
    else the last sight of a link.
    """
    own = links.join(records.select("canonical_id", "intake_type"), "canonical_id")
    g = own.groupBy("source_name").agg(F.count("*").alias("records"), F.count_if(F.col("intake_type") == "stray").alias("strays"), F.max("link_seen").alias("_seen"))
    d = catalog.join(g, "source_name", "left").join(cursors.select("source_name", "cursor"), "source_name", "left").withColumn("last_success", F.coalesce("cursor", "_seen"))
    age = F.greatest(F.lit(0), seconds_between(now, F.col("last_success")))
    status = F.when(F.coalesce("records", F.lit(0)) == 0, "SILENT").when(F.col("last_success").isNull(), "STALE").when(age <= RECENT_SECONDS, "LIVE").when(age > F.col("cadence") * STALE_TIMES, "STALE").otherwise("LIVE")
    return d.select(
        "source_name", metro_label(F.col("source_name")).alias("metro"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("strays", F.lit(0)).alias("strays"), "last_success", status.alias("status"),
    )


def next_cursors(cursors: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored cursors (source_name, cursor) after a batch: the last sight of a source's rows, never behind where it stood."""
    fresh = batch.groupBy("source_name").agg(F.max("last_seen").alias("_fresh"))
    return cursors.join(fresh, "source_name", "full_outer").select("source_name", F.greatest("cursor", "_fresh").alias("cursor"))


def resumed(feed: DataFrame, cursors: DataFrame) -> DataFrame:
    """The rows of a feed that its source's cursor hasn't passed; all of a source without one."""
    return feed.join(cursors, "source_name", "left").where(F.col("cursor").isNull() | (F.col("last_seen") > F.col("cursor"))).drop("cursor")


def poll_outcomes(records: DataFrame, tick: Column) -> DataFrame:
    """Totals and strays of each source and tick."""
    return records.groupBy("source_name", tick.alias("tick")).agg(F.count("*").alias("total"), F.count_if(F.col("intake_type").isin("stray", "found_report")).alias("strays"))


def source_freshness(records: DataFrame, now: Column) -> DataFrame:
    """Per source: records and a status by whole hours since the newest: under 6 live, under 48 stale."""
    hours = F.floor(seconds_between(now, F.col("newest")) / 3600)
    g = records.groupBy("source_name").agg(F.count("*").alias("records"), F.max("last_seen").alias("newest"))
    return g.select("source_name", "records", F.when(hours < 6, "LIVE").when(hours < 48, "STALE").otherwise("SILENT").alias("status"))


def wall_stats(records: DataFrame) -> DataFrame:
    """Counts of the wall in one pass, and when its newest record was made."""
    photo = F.size("photos") > 0
    return records.agg(F.count("*").alias("total"), F.count_if(photo).alias("with_photo"), F.count_if(F.col("species") == "dog").alias("dogs"), F.count_if(F.col("species") == "cat").alias("cats"), F.max("created_at").alias("newest"))

