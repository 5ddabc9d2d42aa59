"""Queries over the store and its maintenance: the first two thirds of the month are the store, the rest is the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..operators.rounds import new_folder, numbered
from ..operators.versions import Store
from .registry import query

CUT = "2024-01-20 00:00:00"


def cut():
    return F.lit(CUT).cast("timestamp")


def batch(t):
    return t.v_intake.where(F.col("last_seen") >= cut())


def links(t):
    """Links as the store had them before the batch."""
    return t.v_intake.where((F.col("last_seen") < cut()) & F.col("source_animal_id").isNotNull()).groupBy("source_name", "source_animal_id").agg(F.min("canonical_id").alias("canonical_id"))


LINKS = f"SELECT source_name, source_animal_id, min(canonical_id) AS known FROM v_intake WHERE last_seen < TIMESTAMP '{CUT}' AND source_animal_id IS NOT NULL GROUP BY ALL"
NEW_ID = "upper(left(sha256(b.source_name || '|' || coalesce(b.source_animal_id, '') || '|' || b.event_id), 26))"
BATCH = f"SELECT b.*, l.known, coalesce(l.known, {NEW_ID}) AS resolved_id FROM v_intake b LEFT JOIN ({LINKS}) l ON b.source_name = l.source_name AND b.source_animal_id = l.source_animal_id WHERE b.last_seen >= TIMESTAMP '{CUT}'"


@query(f"SELECT canonical_id, resolved_id, known IS NULL AS is_new FROM ({BATCH})")
def resolve_ids(t):
    return store.resolve_ids(batch(t), links(t)).select("canonical_id", "resolved_id", "is_new")


@query(f"""SELECT canonical_id, resolved_id, CASE WHEN availability = 'departed' OR outcome_date IS NOT NULL THEN 'departed' WHEN known IS NULL AND (source_animal_id IS NULL OR row_number() OVER (PARTITION BY source_name, source_animal_id ORDER BY event_id) = 1) THEN 'new' ELSE 'updated' END AS kind FROM ({BATCH})""")
def change_events(t):
    return store.change_events(batch(t), links(t)).select("canonical_id", "resolved_id", "kind")


def keyed(d):
    return d.where("source_animal_id is not null").select(F.concat_ws("/", "source_name", "source_animal_id").alias("key"), "species", "availability", "event_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("created_at"), F.lit(1).alias("absent_count"), "source_name", "source_animal_id")


KEYED = "SELECT source_name || '/' || source_animal_id AS key, species, availability, event_id, epoch_us(last_seen) AS created_at FROM v_intake WHERE source_animal_id IS NOT NULL AND last_seen {} TIMESTAMP '" + CUT + "' QUALIFY row_number() OVER (PARTITION BY source_name, source_animal_id ORDER BY event_id DESC) = 1"


@query(f"""WITH o AS ({KEYED.format('<')}), n AS ({KEYED.format('>=')}) SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN o.species ELSE n.species END AS species, CASE WHEN n.key IS NULL THEN o.availability ELSE n.availability END AS availability,
CASE WHEN n.key IS NULL THEN o.event_id ELSE n.event_id END AS event_id, coalesce(o.created_at, n.created_at) AS created_at, CAST(CASE WHEN n.key IS NULL THEN 1 ELSE 0 END AS INT) AS absent_count FROM o FULL JOIN n ON o.key = n.key""")
def upsert(t):
    old, new = (store.last_of_batch(keyed(d)).drop("source_name", "source_animal_id") for d in (t.v_intake.where(F.col("last_seen") < cut()), batch(t)))
    return store.upsert(old, new, "key")


@query(f"""WITH d AS (SELECT source_name || '/' || source_animal_id AS key, source_name, species, availability, event_id, epoch_us(last_seen) AS created_at, CASE WHEN last_seen < TIMESTAMP '2024-01-10' THEN 1 WHEN last_seen < TIMESTAMP '{CUT}' THEN 2 ELSE 3 END AS part FROM v_intake WHERE source_animal_id IS NOT NULL),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key, part ORDER BY event_id DESC) = 1)
SELECT key, source_name, species, availability, event_id, first_value(created_at) OVER (PARTITION BY key ORDER BY part) AS created_at, CAST(0 AS INT) AS absent_count FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY part DESC) = 1""")
def store_versions(t):
    """The bucketed store after three batches of days, each a version made from the one before it."""
    rows = keyed(t.v_intake).withColumn("at", F.timestamp_micros("created_at"))
    first, second = F.col("at") < F.lit("2024-01-10 00:00:00").cast("timestamp"), F.col("at") < cut()
    held = Store(t.spark, new_folder(t.spark, "store"), rows.drop("at", "source_animal_id").schema)
    for n, part in enumerate((first, ~first & second, ~second), 1):
        held.apply(store.last_of_batch(rows.where(part)).drop("at", "source_animal_id"), n)
    return held.read()


@query(f"""SELECT source_animal_id FROM ({LINKS}) WHERE source_name = 'src1' AND source_animal_id NOT IN (SELECT source_animal_id FROM v_intake WHERE source_name = 'src1' AND source_animal_id IS NOT NULL AND last_seen >= TIMESTAMP '{CUT}')""")
def absent_links(t):
    return store.absent_links(links(t), batch(t), "src1").select("source_animal_id")


def link_state(t):
    d = t.v_intake.where((F.col("last_seen") < cut()) & F.col("source_animal_id").isNotNull())
    g = d.groupBy("source_name", "source_animal_id").agg(F.max("last_confirmed").alias("last_confirmed"), F.max("event_id").alias("_e"))
    return g.select("source_name", "source_animal_id", (F.col("_e") % 2).cast("int").alias("absent_count"), F.col("last_confirmed").cast("timestamp").alias("last_confirmed"), (F.col("_e") % 7 == 0).alias("departed"))


@query(f"""WITH s AS (SELECT source_name, source_animal_id, CAST(max(event_id) % 2 AS INT) AS absent_count, max(last_confirmed) AS last_confirmed, max(event_id) % 7 = 0 AS departed FROM v_intake WHERE last_seen < TIMESTAMP '{CUT}' AND source_animal_id IS NOT NULL GROUP BY ALL),
x AS (SELECT DISTINCT source_animal_id FROM v_intake WHERE source_name = 'src2' AND source_animal_id IS NOT NULL AND last_seen >= TIMESTAMP '{CUT}'),
d AS (SELECT s.*, x.source_animal_id IS NOT NULL AS seen, CASE WHEN source_name <> 'src2' THEN absent_count WHEN x.source_animal_id IS NOT NULL THEN 0 ELSE absent_count + 1 END AS c FROM s LEFT JOIN x USING (source_animal_id)),
g AS (SELECT *, source_name = 'src2' AND NOT departed AND (c >= 2 OR (NOT seen AND coalesce(last_confirmed < TIMESTAMP '2024-01-24 00:00:00', FALSE))) AS gone FROM d)
SELECT source_name, source_animal_id, CAST(c AS INT) AS absent_count, departed OR gone AS departed, gone AS newly_departed FROM g""")
def departures(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return store.departures(link_state(t), batch(t), "src2", now).drop("last_confirmed")


@query(f"""WITH l AS (SELECT source_name, source_animal_id, max(event_id) AS e, max(last_confirmed) AS c FROM v_intake WHERE last_seen < TIMESTAMP '{CUT}' AND source_animal_id IS NOT NULL AND source_name = 'src2' GROUP BY ALL),
g AS (SELECT source_animal_id FROM l WHERE e % 7 <> 0 AND (e % 2 = 1 OR coalesce(c < TIMESTAMP '2024-01-24 00:00:00', FALSE)) AND source_animal_id NOT IN (SELECT source_animal_id FROM v_intake WHERE source_name = 'src2' AND source_animal_id IS NOT NULL AND last_seen >= TIMESTAMP '{CUT}'))
SELECT i.canonical_id, CASE WHEN g.source_animal_id IS NOT NULL THEN 'departed' ELSE i.availability END AS availability, epoch_us(CASE WHEN g.source_animal_id IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE i.outcome_date END) AS outcome_date
FROM v_intake i LEFT JOIN g ON i.source_name = 'src2' AND i.source_animal_id = g.source_animal_id""")
def mark_departed(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    gone = store.departures(link_state(t), batch(t), "src2", now).where("newly_departed")
    records = t.v_intake.withColumn("outcome_date", F.col("outcome_date").cast("timestamp"))
    return store.marked_departed(records, gone, now).select("canonical_id", "availability", F.unix_micros("outcome_date").alias("outcome_date"))


@query("""WITH y AS (SELECT DISTINCT source_name, sync FROM v_sync), l AS (SELECT source_name, source_animal_id, max(sync) AS last_sync FROM v_sync GROUP BY ALL)
SELECT source_name, source_animal_id, last_sync, CAST((SELECT count(*) FROM y WHERE y.source_name = l.source_name AND y.sync > l.last_sync) AS INT) AS strikes FROM l""")
def absence_strikes(t):
    v = t.v_sync
    return store.absence_strikes(v, v.select("source_name", "sync").distinct())



@query("""WITH l AS (SELECT 'a' || CAST(user_id % 400 AS VARCHAR) AS canonical_id, CASE WHEN user_id % 3 = 0 THEN 'src1' ELSE source_name END AS source_name FROM v_intake),
g AS (SELECT canonical_id, count(DISTINCT source_name) AS n, bool_or(source_name = 'src1') AS has FROM l GROUP BY canonical_id) SELECT canonical_id, CASE WHEN n = 1 THEN 'deleted' ELSE 'unlinked' END AS action FROM g WHERE has""")
def delete_source(t):
    l = t.v_intake.select(F.concat(F.lit("a"), (F.col("user_id") % 400).cast("string")).alias("canonical_id"), F.when(F.col("user_id") % 3 == 0, "src1").otherwise(F.col("source_name")).alias("source_name"))  # noqa: E741
    return store.delete_source(l, "src1")


OUTCOME = f"""SELECT b.canonical_id, b.species, CASE WHEN b.source_animal_id IS NULL THEN 'failed' WHEN l.known IS NULL AND row_number() OVER (PARTITION BY b.source_name, b.source_animal_id ORDER BY b.event_id) = 1 THEN 'inserted' ELSE 'skipped' END AS outcome FROM v_intake b
LEFT JOIN ({LINKS}) l ON b.source_name = l.source_name AND b.source_animal_id = l.source_animal_id WHERE b.last_seen >= TIMESTAMP '{CUT}'"""


def backfilled(t):
    return store.backfill_insert(batch(t), links(t), ["source_name", "source_animal_id"])


@query(f"SELECT canonical_id, outcome FROM ({OUTCOME})")
def backfill_insert(t):
    return backfilled(t).select("canonical_id", "outcome")


@query(f"""WITH o AS (SELECT species, count(*) AS fetched, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM ({OUTCOME}) GROUP BY species),
h AS (SELECT species, count(DISTINCT source_name || '/' || source_animal_id) AS held FROM v_intake WHERE last_seen < TIMESTAMP '{CUT}' GROUP BY species), a AS (SELECT species, count(*) AS offered FROM v_intake GROUP BY species),
d AS (SELECT a.species, coalesce(fetched, 0) AS fetched, coalesce(inserted, 0) AS inserted, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed, coalesce(held, 0) + coalesce(inserted, 0) AS stored, offered FROM a LEFT JOIN o ON a.species = o.species LEFT JOIN h ON a.species = h.species)
SELECT * FROM d UNION ALL SELECT 'all', CAST(sum(fetched) AS BIGINT), CAST(sum(inserted) AS BIGINT), CAST(sum(skipped) AS BIGINT), CAST(sum(failed) AS BIGINT), CAST(sum(stored) AS BIGINT), CAST(sum(offered) AS BIGINT) FROM d""")
def backfill_report(t):
    held = t.v_intake.where((F.col("last_seen") < cut()) & F.col("source_animal_id").isNotNull()).select("species", "source_name", "source_animal_id").distinct()
    return store.backfill_report(backfilled(t), held, t.v_intake.groupBy("species").agg(F.count("*").alias("total")))


@query("SELECT species, count(*) AS total, CAST(ceil(count(*) / 250) AS BIGINT) AS pages, count(lat) AS with_location FROM v_intake GROUP BY species")
def backfill_plan(t):
    """What a backfill in pages of 250 would fetch; nothing is written."""
    return t.v_intake.groupBy("species").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 250).cast("bigint").alias("pages"), F.count("lat").alias("with_location"))


@query(f"""WITH d AS (SELECT species, CAST(floor((row_number() OVER (PARTITION BY species ORDER BY event_id) - 1) / 250) AS BIGINT) AS page, last_seen FROM v_intake)
SELECT species, page, count(*) AS n FROM d GROUP BY ALL HAVING min(last_seen) >= TIMESTAMP '{CUT}'""")
def backfill_progress(t):
    """Pages still to fetch: those that aren't in the table of processed pages."""
    pages = numbered(t.v_intake.select("species", "event_id", "last_seen"), "species", "event_id").withColumn("page", F.floor(F.col("n") / 250).cast("bigint"))
    done = pages.where(F.col("last_seen") < cut()).select("species", "page").distinct()
    return pages.join(done, ["species", "page"], "left_anti").groupBy("species", "page").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT species, CASE WHEN event_id % 5 = 0 THEN 'not_fetched' WHEN lat IS NOT NULL THEN 'already_set' WHEN event_id % 3 = 0 THEN 'no_location' ELSE 'filled' END AS outcome, CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN 1 ELSE lat END AS now FROM v_intake
UNION ALL SELECT species, 'not_in_store', NULL FROM v_intake WHERE event_id % 23 = 0)
SELECT species, outcome, count(*) AS n, count(now) AS with_location FROM d GROUP BY ALL""")
def location_backfill(t):
    """One fetched row in 23 is of an animal that the store lacks."""
    v = t.v_intake
    strange = v.where("event_id % 23 = 0").select(F.concat(F.lit("x"), "canonical_id").alias("canonical_id"), "species", F.lit(30.0).alias("lat"), F.lit(-97.0).alias("lon"))
    fetched = v.where("event_id % 5 <> 0").select("canonical_id", "species", F.when(F.col("event_id") % 3 != 0, 30.0).alias("lat"), F.when(F.col("event_id") % 3 != 0, -97.0).alias("lon")).unionByName(strange)
    return store.location_backfill(v, fetched).groupBy("species", "outcome").agg(F.count("*").alias("n"), F.count("lat").alias("with_location"))


@query(f"""WITH a AS (SELECT 'a' || user_id AS canonical_id, last_seen, event_id FROM v_intake), h AS (SELECT * FROM a WHERE last_seen < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY last_seen DESC) = 1)
SELECT canonical_id, event_id FROM a QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY last_seen DESC) = 1""")
def delta_refresh(t):
    from pyspark.sql import Window

    a = t.v_intake.select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("canonical_id"), "last_seen", "event_id")
    w = Window.partitionBy("canonical_id").orderBy(F.col("last_seen").desc())
    held = a.where(F.col("last_seen") < cut()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return store.delta_refresh(held, a).select("canonical_id", "event_id")


@query("SELECT DISTINCT canonical_id, p.u AS url FROM v_intake, unnest(photos) AS p(u) WHERE availability <> 'departed'")
def enroll_tasks(t):
    """One enrolment per photo of each record that hasn't departed."""
    d = t.v_intake.where("availability <> 'departed'").select("canonical_id", F.explode("photos").alias("url"))
    return d.dropDuplicates(["canonical_id", "url"])


@query("SELECT canonical_id FROM v_intake WHERE len(photos) > 0 AND event_id NOT IN (SELECT vec_id * 3 FROM embeddings)")
def enroll_worklist(t):
    """Photo-bearing records that the id map lacks, oldest first."""
    mapped = t.embeddings.select((F.col("vec_id") * 3).alias("event_id"))
    return t.v_intake.where(F.size("photos") > 0).join(mapped, "event_id", "left_anti").select("canonical_id").orderBy("canonical_id")
