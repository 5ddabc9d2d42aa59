"""Queries over coverage and store statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, store
from ..sources import feeds
from .feed_queries import FLAT_DUCK, SPECIES, normalized_community, normalized_flat, normalized_jsonapi
from .registry import query
from .views import NOW_TEXT


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


CELLS = "SELECT CAST(floor(lat / 0.5) AS INT) AS lat_idx, CAST(floor(lon / 0.5) AS INT) AS lon_idx, count(*) AS records, count(*) FILTER (intake_type IN ('stray', 'found_report')) AS strays, count(DISTINCT source_name) AS sources, max(last_seen) AS newest FROM v_intake WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL"


@query(f"SELECT lat_idx, lon_idx, records, strays, sources, epoch_us(newest) AS newest, (lat_idx + 0.5) * 0.5::DOUBLE AS centre_lat, (lon_idx + 0.5) * 0.5::DOUBLE AS centre_lon FROM ({CELLS})")
def geo_rollup(t):
    return coverage.geo_rollup(t.v_intake).withColumn("newest", F.unix_micros(F.col("newest").cast("timestamp"))).withColumns({"centre_lat": F.col("centre_lat").cast("double"), "centre_lon": F.col("centre_lon").cast("double")})


SEEDS = "(VALUES ('Los Angeles, CA', 34.05, -118.25), ('New York, NY', 40.71, -74.01), ('Chicago, IL', 41.85, -87.65), ('Houston, TX', 29.76, -95.37), ('Phoenix, AZ', 33.45, -112.07)) AS s(name, lat, lon)"


@query("SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS geocoded, count(*) FILTER (lat IS NULL OR lon IS NULL) AS ungeocoded FROM v_intake")
def geocoding_tally(t):
    return coverage.geocoding_tally(t.v_intake)


# one record in nine has no source, so that some cells have none
SOURCELESS = CELLS.replace("count(DISTINCT source_name)", "count(DISTINCT CASE WHEN event_id % 9 > 0 THEN source_name END)")


@query(f"""WITH c AS ({SOURCELESS}), s AS (SELECT name, CAST(floor(lat / 0.5) AS INT) AS a, CAST(floor(lon / 0.5) AS INT) AS b FROM {SEEDS}),
o AS (SELECT name, a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE lat_idx = a AND lon_idx = b AND sources > 0)
UNION ALL SELECT NULL, lat_idx, lon_idx FROM c WHERE sources = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE a = lat_idx AND b = lon_idx))
SELECT name, a AS lat_idx, b AS lon_idx, CAST(coalesce((SELECT sum(records) FROM c WHERE abs(lat_idx - a) <= 1 AND abs(lon_idx - b) <= 1), 0) AS BIGINT) AS missed FROM o""")
def coverage_holes(t):
    d = t.v_intake.withColumn("source_name", F.when(F.col("event_id") % 9 > 0, F.col("source_name")))
    seeds = t.spark.createDataFrame(coverage.GAPS, "name string, lat double, lon double")
    return coverage.coverage_holes(coverage.geo_rollup(d), seeds).orderBy(F.col("missed").desc(), "lat_idx", "lon_idx")


AGE = f"epoch(TIMESTAMP '{NOW_TEXT}') - floor(epoch(last_confirmed))"


@query(f"""SELECT count(*) AS total, count(*) FILTER (species = 'dog') AS dogs, count(*) FILTER (species = 'cat') AS cats, count(*) FILTER (availability = 'departed') AS departed,
count(*) FILTER ({AGE} <= 3600) AS fresh_1h, count(*) FILTER ({AGE} <= 86400) AS fresh_24h,
count(*) FILTER (availability <> 'departed' AND (last_confirmed IS NULL OR {AGE} > 86400)) AS stale FROM v_intake""")
def ingest_stats(t):
    return coverage.ingest_stats(t.v_intake, now())


CURSORS = "SELECT source_name, max(last_seen) AS cursor FROM v_intake WHERE last_seen < TIMESTAMP '2024-01-20 00:00:00' AND source_name <> 'src3' GROUP BY source_name"
METRO = "CASE source_name WHEN 'long_beach' THEN 'Long Beach, CA' ELSE upper(left(source_name, 1)) || replace(substr(source_name, 2), '_', ' ') END"


def stored_cursors(t):
    """Cursors as a poll on the twentieth left them; one source has none."""
    d = t.v_intake.where("last_seen < timestamp '2024-01-20 00:00:00' and source_name <> 'src3'")
    return d.groupBy("source_name").agg(F.max("last_seen").alias("cursor"))


@query(f"""WITH g AS (SELECT l.source_name, count(*) AS records, count(*) FILTER (i.intake_type = 'stray') AS strays, max(link_seen) AS seen FROM v_link l JOIN v_intake i ON i.canonical_id = l.canonical_id GROUP BY l.source_name),
a AS (SELECT source_name, cadence, records, strays, coalesce(cursor, seen) AS last FROM v_catalog LEFT JOIN g USING (source_name) LEFT JOIN ({CURSORS}) USING (source_name)),
b AS (SELECT *, greatest(0, epoch(TIMESTAMP '{NOW_TEXT}') - floor(epoch(last))) AS age FROM a)
SELECT source_name, {METRO} AS metro, coalesce(records, 0) AS records, coalesce(strays, 0) AS strays, epoch_us(last) AS last_success, CASE WHEN records IS NULL THEN 'SILENT' WHEN last IS NULL THEN 'STALE' WHEN age <= 14400 THEN 'LIVE' WHEN age > cadence * 3 THEN 'STALE' ELSE 'LIVE' END AS status FROM b""")
def source_coverage(t):
    d = coverage.source_coverage(t.v_catalog, t.v_link, t.v_intake, stored_cursors(t), now())
    return d.withColumn("last_success", F.unix_micros(F.col("last_success").cast("timestamp")))


@query(f"SELECT canonical_id FROM v_intake LEFT JOIN ({CURSORS}) USING (source_name) WHERE cursor IS NULL OR last_seen > cursor")
def cursor_resume(t):
    """What a poll after the twentieth still has to read."""
    return coverage.resumed(t.v_intake.select("source_name", "canonical_id", "last_seen"), stored_cursors(t)).select("canonical_id")


@query(f"""WITH g AS (SELECT source_name, count(*) AS records, floor((epoch(TIMESTAMP '{NOW_TEXT}') - floor(epoch(max(last_seen)))) / 3600) AS h FROM v_intake GROUP BY source_name)
SELECT source_name, records, CASE WHEN h < 6 THEN 'LIVE' WHEN h < 48 THEN 'STALE' ELSE 'SILENT' END AS status FROM g""")
def source_freshness(t):
    return coverage.source_freshness(t.v_intake, now())


@query("SELECT count(*) AS total, count(*) FILTER (len(photos) > 0) AS with_photo, count(*) FILTER (species = 'dog') AS dogs, count(*) FILTER (species = 'cat') AS cats, epoch_us(max(first_seen)) AS newest FROM v_intake")
def wall_stats(t):
    d = coverage.wall_stats(t.v_intake.withColumn("created_at", F.col("first_seen").cast("timestamp")))
    return d.withColumn("newest", F.unix_micros("newest"))


@query("SELECT source_name, CAST(date_diff('day', DATE '2024-01-01', CAST(last_seen AS DATE)) AS INT) AS tick, count(*) AS total, count(*) FILTER (intake_type IN ('stray', 'found_report')) AS strays FROM v_intake GROUP BY ALL")
def poll_outcome(t):
    tick = F.date_diff(F.col("last_seen").cast("date"), F.lit("2024-01-01").cast("date"))
    return coverage.poll_outcomes(t.v_intake, tick)


SEX = "CASE k % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END"
AGE_OF = "CASE k % 4 WHEN 0 THEN 'baby' WHEN 1 THEN 'adult' END"


@query(f"SELECT species, breed_primary, {SEX} AS sex, {AGE_OF} AS age_bucket, city_county, CAST(CAST(intake_date AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_intake GROUP BY ALL HAVING count(*) > 1")
def attribute_dupes(t):
    """Records alike in all attributes; null counts as a value."""
    return store.attribute_duplicates(t.v_intake.withColumns({"sex": F.expr(SEX), "age_bucket": F.expr(AGE_OF)}))


@query(f"SELECT name AS metro FROM {SEEDS} WHERE name NOT IN (SELECT metro FROM v_catalog)")
def documented_gaps(t):
    wanted = t.spark.createDataFrame([(x[0],) for x in coverage.GAPS], "metro string")
    return wanted.join(t.v_catalog.select("metro"), "metro", "left_anti")


@query(f"""SELECT source_name, source_animal_id, species FROM (SELECT 'austin' AS source_name, animal_id AS source_animal_id, {SPECIES} AS species FROM ({FLAT_DUCK})) WHERE species IS NOT NULL
UNION ALL SELECT 'rescuegroups', CAST(event_id AS VARCHAR), 'dog' FROM ev
UNION ALL SELECT CASE WHEN k % 2 = 0 THEN 'helpinglostpets' ELSE 'petfbi' END, CAST(event_id AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'dog' ELSE 'cat' END FROM ev""")
def union_sources(t):
    """The normalised feeds of three shapes as one table."""
    parts = [normalized_flat(t), normalized_jsonapi(t), normalized_community(t)]
    return feeds.united(parts).select("source_name", "source_animal_id", "species")


@query("SELECT canonical_id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY source_name, source_animal_id ORDER BY event_id) AS n FROM v_intake WHERE source_animal_id IS NOT NULL) WHERE n = 1")
def feed_dedup(t):
    """The first of the rows of one animal."""
    return store.first_of_feed(t.v_intake.where("source_animal_id is not null"), "event_id").select("canonical_id", "source_name")


@query(f"SELECT coalesce(c.source_name, b.source_name) AS source_name, epoch_us(greatest(cursor, last)) AS cursor FROM ({CURSORS}) c FULL JOIN (SELECT source_name, max(last_seen) AS last FROM v_intake WHERE event_id % 3 = 0 GROUP BY source_name) b ON b.source_name = c.source_name")
def cursors(t):
    """The stored high-water mark of each source after another batch, from which its next poll goes on."""
    d = coverage.next_cursors(stored_cursors(t), t.v_intake.where("event_id % 3 = 0"))
    return d.select("source_name", F.unix_micros(F.col("cursor").cast("timestamp")).alias("cursor"))
