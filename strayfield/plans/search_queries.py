"""Queries over search, filters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, search
from .hits import HITS, photo_hits
from .match_queries import km
from .registry import query

SINCE = "2024-01-10 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp")


@query(f"""WITH m AS (SELECT canonical_id, last_seen FROM v_intake WHERE species = 'dog' AND first_seen >= TIMESTAMP '{SINCE}' AND contains(lower(coalesce(breed_primary, '')), 'retriever')
 AND len([c for c in colors if contains(lower(c), 'a')]) > 0 AND {km('lat', 'lon', '35.0', '-100.0')} <= 2500 AND contains(city_county, '787'))
SELECT canonical_id, (SELECT count(*) FROM m) > 20 AS truncated FROM m ORDER BY last_seen DESC, canonical_id LIMIT 20""")
def search_pets(t):
    d = search.search(t.v_intake, "dog", at(SINCE), "Retriever", "A", (35.0, -100.0, 2500.0), "787").select("canonical_id", "last_seen")
    return search.limited(d, [F.col("last_seen").desc(), F.col("canonical_id")], 20).select("canonical_id", "truncated")


@query("""WITH m AS (SELECT canonical_id, last_seen FROM v_intake WHERE species = 'cat' AND contains(city_county, '7870') AND state = 'CA' AND intake_date > TIMESTAMP '2024-01-05 00:00:00')
SELECT canonical_id, (SELECT count(*) FROM m) > 50 AS truncated FROM m ORDER BY last_seen DESC, canonical_id LIMIT 50""")
def shelter_query(t):
    d = search.shelter_query(t.v_intake, "cat", "7870", "CA", at("2024-01-05 00:00:00")).select("canonical_id", "last_seen")
    return search.limited(d, [F.col("last_seen").desc(), F.col("canonical_id")], 50).select("canonical_id", "truncated")


@query("SELECT canonical_id, species, breed_primary, intake_type, availability, city_county, state, array_to_string(photos, ' ') AS photo_urls, 'brokered-via:' || source_name AS contact FROM v_intake")
def pet_summary(t):
    return search.summary(t.v_intake).withColumn("photo_urls", F.array_join("photo_urls", " "))


@query("SELECT report_id, species, status, epoch_us(expires) AS expires, 'tok_' || left(sha256('pepper' || contact), 16) AS contact_token FROM v_lost_report WHERE status = 'active'")
def active_reports(t):
    return reports.summary(t.v_lost_report.where("status = 'active'"), "pepper").withColumn("expires", F.unix_micros(F.col("expires").cast("timestamp")))


@query("SELECT canonical_id, 'stray is adoptable' AS conflict FROM v_intake WHERE intake_type = 'stray' AND availability = 'adoptable'")
def stray_hold_conflicts(t):
    return t.v_intake.where("intake_type = 'stray' AND availability = 'adoptable'").select("canonical_id", F.lit("stray is adoptable").alias("conflict"))


@query("SELECT canonical_id FROM v_intake WHERE len(photos) > 0")
def photo_bearing(t):
    return t.v_intake.where(F.size("photos") > 0).select("canonical_id")


CURSOR = "2024-01-20 00:00:00"


@query(f"""SELECT CASE user_id % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'nested' WHEN 2 THEN 'geojson' WHEN 3 THEN 'jsonapi' ELSE 'community' END AS feed, canonical_id FROM v_intake
WHERE CASE user_id % 5 WHEN 3 THEN last_seen >= TIMESTAMP '{CURSOR}' WHEN 2 THEN floor(epoch_us(last_seen) / 1000) > epoch_us(TIMESTAMP '{CURSOR}') / 1000 ELSE last_seen > TIMESTAMP '{CURSOR}' END""")
def delta_since(t):
    """Rows beyond each feed's cursor: GeoJSON counts milliseconds, JSON:API reads the boundary again."""
    feed = F.element_at(F.array(*[F.lit(x) for x in ("flat", "nested", "geojson", "jsonapi", "community")]), (F.col("user_id") % 5 + 1).cast("int"))
    d = t.v_intake.withColumn("feed", feed)
    parts = [search.since_cursor(d.where(F.col("feed") == f), F.col("last_seen").cast("timestamp"), at(CURSOR), f) for f in ("flat", "nested", "geojson", "jsonapi", "community")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feed", "canonical_id")


@query("SELECT canonical_id, species, availability FROM v_intake WHERE canonical_id = lpad('77', 26, '0')")
def get_pet(t):
    return t.v_intake.where(F.col("canonical_id") == "77".rjust(26, "0")).select("canonical_id", "species", "availability")


@query("""WITH p AS (SELECT canonical_id, species, photos[1] AS photo FROM v_intake WHERE len(photos) > 0 AND canonical_id < lpad('900', 26, '0') ORDER BY canonical_id DESC LIMIT 31),
n AS (SELECT *, row_number() OVER (ORDER BY canonical_id DESC) AS pos, count(*) OVER () AS n FROM p), g AS (SELECT * FROM n WHERE pos <= 30)
SELECT canonical_id, species, photo, n > 30 AS has_more, (SELECT min(canonical_id) FROM g) AS next_cursor FROM g""")
def keyset_page(t):
    return search.keyset_page(t.v_intake, "900".rjust(26, "0"), 30)


@query("SELECT canonical_id FROM v_intake WHERE len(photos) > 0 AND canonical_id > lpad('500', 26, '0')")
def arrivals_since(t):
    return t.v_intake.where((F.size("photos") > 0) & (F.col("canonical_id") > "500".rjust(26, "0"))).select("canonical_id").orderBy("canonical_id")


@query("SELECT canonical_id, species FROM v_intake ORDER BY last_seen DESC, canonical_id LIMIT 20")
def recent_intakes(t):
    return search.recent(t.v_intake).select("canonical_id", "species")


@query("SELECT canonical_id, epoch_us(last_seen) AS last_seen FROM v_intake WHERE species = 'dog'")
def list_by_species(t):
    return t.v_intake.where("species = 'dog'").select("canonical_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen")).orderBy(F.col("last_seen").desc())


@query(f"""SELECT report_id, candidate_id, 'This animal has a similarity score of ' || printf('%.1f', score * 100) || '% — please review in person to confirm.' AS explanation FROM {HITS} ORDER BY round(score, 9) DESC, report_id, candidate_id LIMIT 50""")
def similarity_shortlist(t):
    top = photo_hits(t).orderBy(F.round("score", 9).desc(), "report_id", "candidate_id").limit(50)
    return top.select("report_id", "candidate_id", search.explanation(F.col("score")).alias("explanation"))
