"""Lost reports: submission, lifecycle, alerts with an at-most-once ledger, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import primary_photo

TTL_DAYS = 90


def contact_token(raw: Column, salt: str) -> Column:
    """An opaque token; the raw contact is not kept."""
    return F.concat(F.lit("tok_"), F.left(F.sha2(F.concat(F.lit(salt), raw), 256), F.lit(16)))


def summary(reports: DataFrame, salt: str) -> DataFrame:
    """What is shown of a report: no contact but its token."""
    return reports.select("report_id", "species", "status", "expires", contact_token(F.col("contact"), salt).alias("contact_token"))


def submit_reports(reports: DataFrame, known: DataFrame, salt: str) -> DataFrame:
    """Reports with token and expiry and a status: accepted, duplicate (id already known), or bad_url (notify_url isn't http or https)."""
    d = reports.join(known.select("report_id").distinct().withColumn("_known", F.lit(True)), "report_id", "left")
    good = F.col("notify_url").isNull() | F.lower(F.try_parse_url("notify_url", F.lit("PROTOCOL"))).isin("http", "https")
    status = F.when(F.col("_known"), "duplicate").when(~F.coalesce(good, F.lit(False)), "bad_url").otherwise("accepted")
    return d.select("report_id", "species", contact_token(F.col("contact"), salt).alias("contact_token"), (F.col("created") + F.expr(f"INTERVAL {TTL_DAYS} DAYS")).alias("expires"), status.alias("outcome"))


def lifecycle(reports: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Apply actions (report_id, action): reunited marks, delete and expiry purge. Gives report_id, status, purged."""
    d = reports.join(actions, "report_id", "left")
    expired = (F.col("expires") <= now) & (F.col("status") == "active")
    gone = (F.coalesce("action", F.lit("")) == "delete") | (expired & (F.coalesce("action", F.lit("")) != "reunited"))
    return d.select("report_id", F.when(F.col("action") == "reunited", "reunited").otherwise(F.col("status")).alias("status"), gone.alias("purged"))


def expired_reports(reports: DataFrame, now: Column) -> DataFrame:
    return reports.where((F.col("status") == "active") & (F.col("expires") <= now)).select("report_id")


def new_alerts(candidates: DataFrame, ledger: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Candidates (report_id, candidate_id) once each, without those that the ledger has delivered: all but the suppressed, failures too."""
    done = ledger.where(F.col("outcome") != "Suppressed")
    if retry_failed:
        done = done.where(F.col("outcome") != "Failed")
    return candidates.dropDuplicates(["report_id", "candidate_id"]).join(done.select("report_id", "candidate_id").distinct(), ["report_id", "candidate_id"], "left_anti")


def alerts_by_report(alerts: DataFrame) -> DataFrame:
    """(report_id, alerts, n) from (report_id, candidate_id, alerted_at): a report's candidates in the order of their alerts, comma-joined."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("alerted_at", "candidate_id"))), lambda a: a["candidate_id"])
    return alerts.groupBy("report_id").agg(F.array_join(listed, ",").alias("alerts"), F.count("*").alias("n"))


def alert_message(species: Column, city: Column, state: Column, deadline: Column) -> Column:
    area = F.when(city.isNotNull(), F.concat(F.lit(" at "), F.concat_ws(", ", city, state)))
    hold = F.concat(F.lit(" This animal is a stray in hold; reclaim deadline: "), F.date_format(deadline, "yyyy-MM-dd HH:mm"), F.lit(" UTC."))
    return F.concat_ws("", F.lit("A possible match for your "), species, F.lit(" appeared"), area, F.lit(" — please review the animal at the shelter listing to confirm."), hold)


def candidate_framed(message: Column) -> Column:
    low = F.lower(message)
    return (low.contains("possible") | low.contains("review")) & ~low.contains("we found your pet") & ~low.contains("confirmed match")


def place_line() -> Column:
    line = F.concat_ws(", ", "city", "state", "zip_code")
    return F.when(line == "", "location not specified").otherwise(line)


def flyer(token: Column) -> Column:
    """The flyer text of a report."""
    breed = F.when(F.col("breed_primary").isNotNull(), F.concat(F.lit(" ("), "breed_primary", F.lit(")")))
    animal = F.concat_ws("", F.upper(F.left("species", F.lit(1))), F.substring("species", 2, 100), breed)
    return F.concat_ws(
        "\n", F.lit("LOST PET — PLEASE HELP"), F.lit("======================="), F.concat(F.lit("Animal      : "), animal), F.concat(F.lit("Last seen   : "), place_line()),
        F.concat(F.lit("Report date : "), F.date_format("created", "yyyy-MM-dd")), F.concat(F.lit("Contact (via relay) : "), token), F.lit(""), F.lit("Please post this flyer to local lost-pet groups."), F.concat(F.lit("Report ID   : "), "report_id"), F.lit(""),
    )


def short_flyer(token: Column, photos: Column, relay: str = "https://relay.example/relay/") -> Column:
    """The shorter flyer: colours and description cut at 100 characters, the first primary photo of ``photos`` (url, is_primary), a relay link."""
    photo = F.nullif(primary_photo(photos), F.lit(""))
    about = F.left(F.concat_ws(", ", F.nullif(F.array_join("colors", ", "), F.lit("")), "description"), F.lit(100))
    return F.concat_ws(
        "\n", F.concat(F.lit("LOST: Unknown ("), "species", F.lit(" / "), F.coalesce("breed_primary", F.lit("mixed")), F.lit(")")), F.concat(F.lit("Last seen: "), place_line(), F.lit(" on "), F.date_format("created", "yyyy-MM-dd")),
        F.concat(F.lit("Description: "), F.when(about == "", "(none)").otherwise(about)), F.concat(F.lit("Photo: "), F.coalesce(photo, F.lit("none"))), F.concat(F.lit("Contact: " + relay), token), F.lit("---"), F.lit("Please post to local groups with this flyer."), F.lit(""),
    )


def to_jsonld(token: Column) -> Column:
    """A report as JSON-LD; keys without a value are left out, the contact is its token alone."""
    named = lambda c, n: F.col(c).alias(n)
    animal = F.struct(F.lit("schema:Animal").alias("@type"), named("species", "schema:species"), named("breed_primary", "schema:breed"), named("description", "schema:description"))
    spot = F.struct(F.lit("schema:Place").alias("@type"), named("city", "schema:addressLocality"), named("state", "schema:addressRegion"), named("zip_code", "schema:postalCode"))
    photos = F.transform("photos", lambda p, i: F.struct(F.lit("schema:ImageObject").alias("@type"), p.alias("schema:contentUrl"), (i == 0).alias("lost:isPrimary")))
    return F.to_json(F.struct(
        F.struct(F.lit("https://schema.org/").alias("schema"), F.lit("https://lost.example/ns#").alias("lost")).alias("@context"), F.lit("lost:LostReport").alias("@type"), named("report_id", "lost:reportId"), animal.alias("lost:animal"), spot.alias("lost:lastSeenLocation"),
        photos.alias("schema:image"), token.alias("lost:brokerRelayToken"), named("status", "lost:lostStatus"), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("schema:dateCreated"), F.date_format("expires", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("schema:expires"),
    ))


def write_artefacts(reports: DataFrame, token: Column, folder: str) -> None:
    """JSON-LD and flyer of every report as text, in one folder per kind; a job writes them all."""
    rows = reports.select("report_id", F.explode(F.create_map(F.lit("jsonld"), to_jsonld(token), F.lit("flyer"), flyer(token))).alias("kind", "value"))
    rows.select("kind", F.concat_ws("\t", "report_id", F.regexp_replace("value", "\n", "\\\\n")).alias("value")).write.partitionBy("kind").text(folder)
