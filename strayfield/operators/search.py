"""Filters, projections, top-k and pages over intake records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km


def search(records: DataFrame, species: str | None = None, since: Column | None = None, breed: str | None = None, color: str | None = None, near: tuple[float, float, float] | None = None, postal: str | None = None) -> DataFrame:
    """Records that meet all given filters. Unknown coordinates fail ``near`` (lat, lon, km); text filters ignore case."""
    d = records
    if species:
        d = d.where(F.col("species") == species)
    if since is not None:
        d = d.where(F.col("first_seen") >= since)
    if breed:
        d = d.where(F.lower(F.coalesce("breed_primary", F.lit(""))).contains(breed.lower()))
    if color:
        d = d.where(F.exists("colors", lambda c: F.lower(c).contains(color.lower())))
    if near:
        d = d.where(haversine_km(F.col("lat"), F.col("lon"), F.lit(near[0]), F.lit(near[1])) <= near[2])
    if postal:
        d = d.where(F.col("city_county").contains(postal))
    return d


def shelter_query(records: DataFrame, species: str | None = None, postal: str | None = None, state: str | None = None, after: Column | None = None) -> DataFrame:
    d = records
    for given, test in ((species, lambda: F.col("species") == species), (postal, lambda: F.col("city_county").contains(postal)), (state, lambda: F.col("state") == state), (after, lambda: F.col("intake_date") > after)):
        if given is not None:
            d = d.where(test())
    return d


def limited(d: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows, with ``truncated`` telling whether there are more: one row beyond the limit is looked at, no more."""
    few = d.orderBy(*order).limit(limit + 1).withColumn("_one", F.lit(1))
    from pyspark.sql import Window

    whole = Window.partitionBy("_one")
    numbered = few.withColumns({"_at": F.row_number().over(whole.orderBy(*order)), "_n": F.count("*").over(whole)})
    return numbered.where(F.col("_at") <= limit).withColumn("truncated", F.col("_n") > limit).drop("_one", "_at", "_n")


def summary(records: DataFrame) -> DataFrame:
    """The public shape: no contacts, photos as links, the source as broker."""
    return records.select("canonical_id", "species", "breed_primary", "intake_type", "availability", "city_county", "state", F.col("photos").alias("photo_urls"), F.concat(F.lit("brokered-via:"), "source_name").alias("contact"))


def keyset_page(records: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """A page of photo-bearing records below ``cursor``, newest id first, with has_more and next_cursor."""
    limit = min(200, max(1, limit))
    d = records.where(F.size("photos") > 0)
    if cursor is not None:
        d = d.where(F.col("canonical_id") < cursor)
    page = limited(d.select("canonical_id", "species", F.get("photos", 0).alias("photo")), [F.col("canonical_id").desc()], limit)
    last = page.agg(F.min("canonical_id").alias("next_cursor"))
    return page.withColumnRenamed("truncated", "has_more").crossJoin(F.broadcast(last))  # a page and one row


def recent(records: DataFrame, limit: int = 20) -> DataFrame:
    return records.orderBy(F.col("last_seen").desc(), "canonical_id").limit(min(50, max(1, limit)))


def since_cursor(records: DataFrame, seen: Column, cursor: Column, feed: str) -> DataFrame:
    """What a feed has beyond its cursor: strictly later rows; GeoJSON compares whole milliseconds, and JSON:API takes the boundary again."""
    if feed == "geojson":
        return records.where(F.unix_millis(seen) > F.unix_millis(cursor))
    return records.where(seen >= cursor if feed == "jsonapi" else seen > cursor)


def explanation(score: Column) -> Column:
    return F.format_string("This animal has a similarity score of %.1f%% — please review in person to confirm.", score * 100)
