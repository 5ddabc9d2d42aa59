"""Free-text places to coordinates by lookups in a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import place

#: A gazetteer has a row per named place; it is broadcast up to so many, else the joins shuffle.
BROADCAST_PLACES = 500_000


def geocode(rows: DataFrame, gazetteer: DataFrame, text: str = "place_text") -> DataFrame:
    """Add lat, lon, outcome and located_by, which is ``found_text`` for the rows that the text has located. A zip in the text comes first, then
    "city, ST" or "city ST"; rows that have coordinates keep them."""
    few = gazetteer.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    hint = F.broadcast if few else (lambda d: d)
    zips = gazetteer.where("zip is not null").groupBy("zip").agg(F.max("lat").alias("_zlat"), F.max("lon").alias("_zlon"))
    cities = gazetteer.where("zip is null").groupBy(F.lower("name").alias("city"), F.col("state").alias("st")).agg(F.max("lat").alias("_clat"), F.max("lon").alias("_clon"))
    p = place(F.col(text))
    d = rows.withColumns({"_zip": p["zip"], "_city": p["city"], "_st": p["state"]})
    d = d.join(hint(zips), d["_zip"] == zips["zip"], "left").drop("zip").join(hint(cities), (F.col("_city") == F.col("city")) & (F.col("_st") == F.col("st")), "left").drop("city", "st")
    has = "lat" in rows.columns
    lat, lon = F.coalesce("_zlat", "_clat"), F.coalesce("_zlon", "_clon")
    set_ = F.col("lat").isNotNull() if has else F.lit(False)
    outcome = F.when(set_, "already_set").when(lat.isNotNull(), "filled").otherwise("not_resolved")
    return d.withColumns({"outcome": outcome, "located_by": F.when(~set_ & lat.isNotNull(), "found_text"), "lat": F.when(set_, F.col("lat") if has else F.lit(None)).otherwise(lat), "lon": F.when(set_, F.col("lon") if has else F.lit(None)).otherwise(lon)}).drop("_zip", "_city", "_st", "_zlat", "_zlon", "_clat", "_clon")
