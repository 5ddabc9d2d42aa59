"""Queries over reports, alerts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, reports
from .hits import HITS, photo_hits
from .registry import query
from .views import NOW_TEXT

SALT = "pepper"
TOKEN = f"'tok_' || left(sha256('{SALT}' || contact), 16)"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def token():
    return reports.contact_token(F.col("contact"), SALT)


@query(f"SELECT report_id, {TOKEN} AS token FROM v_lost_report")
def contact_token(t):
    return t.v_lost_report.select("report_id", token().alias("token"))


@query(f"""SELECT report_id, species, {TOKEN} AS contact_token, epoch_us(created + INTERVAL 90 DAYS) AS expires, CASE WHEN n % 13 = 0 THEN 'duplicate' WHEN notify_url LIKE 'ftp%' THEN 'bad_url' ELSE 'accepted' END AS outcome FROM v_lost_report""")
def submit_reports(t):
    d = reports.submit_reports(t.v_lost_report, t.v_lost_report.where("n % 13 = 0"), SALT)
    return d.withColumn("expires", F.unix_micros(F.col("expires").cast("timestamp")))


@query(f"SELECT report_id FROM v_lost_report WHERE status = 'active' AND expires <= TIMESTAMP '{NOW_TEXT}'")
def expire_reports(t):
    return reports.expired_reports(t.v_lost_report, now())


@query(f"""SELECT report_id, CASE WHEN n % 11 = 0 THEN 'reunited' ELSE status END AS status, n % 7 = 0 AND n % 11 <> 0 OR (expires <= TIMESTAMP '{NOW_TEXT}' AND status = 'active' AND n % 11 <> 0) AS purged FROM v_lost_report""")
def report_lifecycle(t):
    actions = t.v_lost_report.where("n % 11 = 0 or n % 7 = 0").select("report_id", F.when(F.col("n") % 11 == 0, "reunited").otherwise("delete").alias("action"))
    return reports.lifecycle(t.v_lost_report, actions, now())


CAND = f"SELECT DISTINCT report_id, candidate_id, species FROM {HITS} WHERE score >= 0.3"
NEW = f"SELECT c.* FROM ({CAND}) c WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.report_id = c.report_id AND l.candidate_id = c.candidate_id AND outcome <> 'Suppressed')"


def somewhat_alike(t):
    """Hits at a low threshold, at which there are many."""
    return photo_hits(t).where("score >= 0.3")


@query(f"SELECT report_id, candidate_id FROM ({NEW})")
def new_alerts(t):
    return reports.new_alerts(somewhat_alike(t).select("report_id", "candidate_id"), t.v_ledger)


@query(f"SELECT a.report_id, a.candidate_id, r.species FROM ({NEW}) a JOIN v_lost_report r ON r.report_id = a.report_id AND r.species = a.species WHERE r.status = 'active'")
def alert_join(t):
    """Alerts for active reports of the candidate's species, each pair once and never twice."""
    return match.alerts(photo_hits(t), t.v_lost_report, t.v_ledger, threshold=0.3)


@query(f"""SELECT report_id, string_agg(candidate_id, ',' ORDER BY alerted_at, candidate_id) AS alerts, count(*) AS n
FROM (SELECT c.report_id, c.candidate_id, (SELECT max(last_seen) FROM v_intake i WHERE i.canonical_id = c.candidate_id) AS alerted_at FROM ({CAND}) c) GROUP BY report_id""")
def alerts_by_report(t):
    """A report's alerts in the order of time: an alert is raised when its animal is seen."""
    at = t.v_intake.select(F.col("canonical_id").alias("candidate_id"), F.col("last_seen").alias("alerted_at"))
    return reports.alerts_by_report(somewhat_alike(t).select("report_id", "candidate_id").join(at, "candidate_id"))


@query("""SELECT canonical_id, 'A possible match for your ' || species || ' appeared at ' || city_county || coalesce(', ' || state, '') || ' — please review the animal at the shelter listing to confirm.' ||
coalesce(' This animal is a stray in hold; reclaim deadline: ' || strftime(CASE WHEN intake_type = 'stray' AND availability = 'in_custody' THEN intake_date + INTERVAL 5 DAYS END, '%Y-%m-%d %H:%M') || ' UTC.', '') AS message, TRUE AS framed FROM v_intake""")
def alert_message(t):
    from ..functions.score import hold_deadline

    message = reports.alert_message(F.col("species"), F.col("city_county"), F.col("state"), hold_deadline(F.col("intake_type"), F.col("availability"), F.col("intake_date")))
    return t.v_intake.select("canonical_id", message.alias("message"), reports.candidate_framed(message).alias("framed"))


LINE = "coalesce(nullif(concat_ws(', ', city, state, zip_code), ''), 'location not specified')"


@query(f"""SELECT report_id, 'LOST PET — PLEASE HELP' || chr(10) || '=======================' || chr(10) || 'Animal      : ' || upper(left(species, 1)) || substr(species, 2) || coalesce(' (' || breed_primary || ')', '') || chr(10) || 'Last seen   : ' || {LINE} || chr(10) ||
'Report date : ' || strftime(created, '%Y-%m-%d') || chr(10) || 'Contact (via relay) : ' || {TOKEN} || chr(10) || chr(10) || 'Please post this flyer to local lost-pet groups.' || chr(10) || 'Report ID   : ' || report_id || chr(10) AS flyer,
'LOST: Unknown (' || species || ' / ' || coalesce(breed_primary, 'mixed') || ')' || chr(10) || 'Last seen: ' || {LINE} || ' on ' || strftime(created, '%Y-%m-%d') || chr(10) || 'Description: ' || coalesce(nullif(left(concat_ws(', ', nullif(array_to_string(colors, ', '), ''), description), 100), ''), '(none)') || chr(10) ||
'Photo: ' || coalesce(CASE WHEN n % 2 = 0 AND len(photos) > 0 THEN 'https://img.example/primary.jpg' END, photos[1], 'none') || chr(10) || 'Contact: https://relay.example/relay/' || {TOKEN} || chr(10) || '---' || chr(10) || 'Please post to local groups with this flyer.' || chr(10) AS short_flyer FROM v_lost_report""")
def flyer_text(t):
    # even reports have a second photo, which is marked as the primary one
    first = F.transform("photos", lambda p: F.struct(p.alias("url"), F.lit(False).alias("is_primary")))
    second = F.array(F.struct(F.lit("https://img.example/primary.jpg").alias("url"), F.lit(True).alias("is_primary")))
    marked = F.when((F.col("n") % 2 == 0) & (F.size("photos") > 0), F.concat(first, second)).otherwise(first)
    return t.v_lost_report.select("report_id", reports.flyer(token()).alias("flyer"), reports.short_flyer(token(), marked).alias("short_flyer"))


@query(f"""SELECT report_id, species, breed_primary, city, state, zip_code, {TOKEN} AS token, len(photos) AS n_photos, photos[1] AS photo, strftime(created, '%Y-%m-%dT%H:%M:%SZ') AS created FROM v_lost_report""")
def jsonld_export(t):
    """The export, read back: keys of null values are absent, so they come back as null."""
    schema = "`lost:reportId` string, `lost:animal` struct<`schema:species`:string,`schema:breed`:string>, `lost:lastSeenLocation` struct<`schema:addressLocality`:string,`schema:addressRegion`:string,`schema:postalCode`:string>, `schema:image` array<struct<`schema:contentUrl`:string>>, `lost:brokerRelayToken` string, `schema:dateCreated` string"
    j = t.v_lost_report.select(F.from_json(reports.to_jsonld(token()), schema).alias("j")).select("j.*")
    c = lambda path: F.col(".".join(f"`{p}`" for p in path))
    return j.select(
        c(["lost:reportId"]).alias("report_id"), c(["lost:animal", "schema:species"]).alias("species"), c(["lost:animal", "schema:breed"]).alias("breed_primary"), c(["lost:lastSeenLocation", "schema:addressLocality"]).alias("city"), c(["lost:lastSeenLocation", "schema:addressRegion"]).alias("state"),
        c(["lost:lastSeenLocation", "schema:postalCode"]).alias("zip_code"), c(["lost:brokerRelayToken"]).alias("token"), F.size(c(["schema:image"])).cast("bigint").alias("n_photos"), F.get(c(["schema:image"]), 0)["schema:contentUrl"].alias("photo"), c(["schema:dateCreated"]).alias("created"),
    )
