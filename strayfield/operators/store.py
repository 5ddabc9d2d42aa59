"""The canonical store: id resolution, upserts, departures, deletions, backfills. All of it reads one version and gives the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIKES, TTL_DAYS = 2, 7


def new_id(*cols: str) -> Column:
    """An id from a record's own keys, the same in every run."""
    return F.upper(F.left(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), F.lit(26)))


def by_animal(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an animal id, rows without one). These are nobody's: they go through no join or window, where they would all meet in one task."""
    return records.where("source_animal_id is not null"), records.where("source_animal_id is null")


def resolved(keyed: DataFrame, loose: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts of ``by_animal`` with resolved_id and is_new."""
    known = links.select("source_name", "source_animal_id", F.col("canonical_id").alias("_known"))
    new = new_id("source_name", "source_animal_id", "event_id")
    d = keyed.join(known, ["source_name", "source_animal_id"], "left")
    d = d.withColumn("resolved_id", F.coalesce("_known", new)).withColumn("is_new", F.col("_known").isNull()).drop("_known")
    return d, loose.withColumn("resolved_id", new).withColumn("is_new", F.lit(True))


def resolve_ids(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with the canonical_id that their (source_name, source_animal_id) is linked to, else a new one. A null animal id is always new."""
    keyed, loose = resolved(*by_animal(records), links)
    return keyed.unionByName(loose)


def last_of_batch(records: DataFrame) -> DataFrame:
    """Of the rows of one animal in a batch the last."""
    w = Window.partitionBy("source_name", "source_animal_id").orderBy(F.col("event_id").desc())
    keyed, loose = by_animal(records)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(loose)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old``, which keep their created_at; absent_count starts again."""
    values = [c for c in old.columns if c not in (key, "created_at", "absent_count")]
    o = old.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"))
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in values], F.col("created_at").alias("_n_created_at"), F.lit(True).alias("_new"))
    pick = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in values]
    return o.join(n, key, "full_outer").select(key, *pick, F.coalesce("_o_created_at", "_n_created_at").alias("created_at"), F.when(F.col("_new"), F.lit(0)).otherwise(F.col("_o_absent_count")).alias("absent_count"))


def change_events(records: DataFrame, links: DataFrame) -> DataFrame:
    """Every record of a batch as an event: departed goes before new, new before updated."""
    keyed, loose = resolved(*by_animal(records), links)
    first = F.row_number().over(Window.partitionBy("source_name", "source_animal_id").orderBy("event_id")) == 1
    d = keyed.withColumn("_first", first).unionByName(loose.withColumn("_first", F.lit(True)))
    gone = (F.col("availability") == "departed") | F.col("outcome_date").isNotNull()
    return d.withColumn("kind", F.when(gone, "departed").when(F.col("is_new") & F.col("_first"), "new").otherwise("updated")).drop("_first")


def absent_links(links: DataFrame, seen: DataFrame, source: str) -> DataFrame:
    """Links of a source that its full sync didn't bring."""
    return links.where(F.col("source_name") == source).join(seen.where(F.col("source_name") == source).select("source_animal_id").distinct(), "source_animal_id", "left_anti")


def departures(state: DataFrame, seen: DataFrame, source: str, now: Column) -> DataFrame:
    """The next state of a source's links (source_name, source_animal_id, absent_count, last_confirmed, departed) after a full sync.

    Seen links start again at 0, absent ones get a strike; two strikes, or no confirmation for seven days, depart. Other sources' rows stay
    as they are, and departed rows are not departed again.
    """
    here = seen.where(F.col("source_name") == source).select("source_animal_id").distinct().withColumn("_seen", F.lit(True))
    d = state.join(here, "source_animal_id", "left")
    own = F.col("source_name") == source
    count = F.when(own & F.col("_seen"), F.lit(0)).when(own, F.col("absent_count") + 1).otherwise(F.col("absent_count"))
    old = F.coalesce(F.col("last_confirmed") < now - F.expr(f"INTERVAL {TTL_DAYS} DAYS"), F.lit(False))
    d = d.withColumn("_count", count)
    gone = own & ~F.col("departed") & ((F.col("_count") >= STRIKES) | (old & F.col("_seen").isNull()))
    return d.select("source_name", "source_animal_id", F.col("_count").alias("absent_count"), "last_confirmed", (F.col("departed") | gone).alias("departed"), gone.alias("newly_departed"))


def marked_departed(records: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """``records`` with those of the links in ``gone`` (source_name, source_animal_id) set to departed, their outcome at ``at``."""
    key = ["source_name", "source_animal_id"]
    d = records.join(gone.select(*key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    availability = F.when(F.col("_gone"), "departed").otherwise(F.col("availability"))
    outcome = F.when(F.col("_gone"), at).otherwise(F.col("outcome_date"))
    return d.withColumns({"availability": availability, "outcome_date": outcome}).drop("_gone").select(*records.columns)


def absence_strikes(presence: DataFrame, syncs: DataFrame) -> DataFrame:
    """From (source_name, source_animal_id, sync) and each source's syncs: how many latest syncs each animal has been absent from."""
    last = syncs.groupBy("source_name").agg(F.array_sort(F.collect_set("sync")).alias("_syncs"))  # one row per source and day of syncs
    seen = presence.groupBy("source_name", "source_animal_id").agg(F.max("sync").alias("last_sync"))
    return seen.join(F.broadcast(last), "source_name").select("source_name", "source_animal_id", "last_sync", F.size(F.filter("_syncs", lambda s: s > F.col("last_sync"))).alias("strikes"))


def delete_source(links: DataFrame, source: str) -> DataFrame:
    """Per canonical_id of a source: deleted if no other source has it, else unlinked."""
    g = links.groupBy("canonical_id").agg(F.countDistinct("source_name").alias("_n"), F.bool_or(F.col("source_name") == source).alias("_has"))
    return g.where("_has").select("canonical_id", F.when(F.col("_n") == 1, "deleted").otherwise("unlinked").alias("action"))


def backfill_insert(fetched: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Fetched rows marked inserted, skipped or failed: known ones are never refreshed, those without a whole key can't be written."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    bad = fetched.where(~whole).withColumn("outcome", F.lit("failed"))
    known = store.select(*key).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("event_id")) == 1
    good = fetched.where(whole).join(known, key, "left").withColumn("outcome", F.when(F.col("_known").isNull() & first, "inserted").otherwise("skipped"))
    return good.drop("_known").unionByName(bad)


def backfill_report(outcomes: DataFrame, store: DataFrame, offered: DataFrame) -> DataFrame:
    """Per species, and for ``all`` together: rows fetched, inserted, skipped and failed, what the store holds after, and what the source offers.

    ``outcomes`` is what ``backfill_insert`` gives, ``store`` what was held before, ``offered`` (species, total) the source's own counts.
    """
    n = {c: F.count_if(F.col("outcome") == c).alias(c) for c in ("inserted", "skipped", "failed")}
    counts = outcomes.groupBy("species").agg(F.count("*").alias("fetched"), *n.values())
    held = store.groupBy("species").agg(F.count("*").alias("_held"))
    d = offered.select("species", F.col("total").alias("offered")).join(counts, "species", "left").join(held, "species", "left").na.fill(0)
    d = d.withColumn("stored", F.col("_held") + F.col("inserted"))
    sums = [F.sum(c).alias(c) for c in ("fetched", *n, "stored", "offered")]
    return d.rollup("species").agg(F.grouping("species").alias("_all"), *sums).withColumn("species", F.when(F.col("_all") == 1, "all").otherwise(F.col("species"))).drop("_all")


def location_backfill(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per store row the outcome of filling its location: only where it is null. Fetched rows that the store lacks are ``not_in_store`` and give no location."""
    f = fetched.select("canonical_id", F.col("species").alias("_species"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_f"))
    d = store.withColumn("_s", F.lit(True)).join(f, "canonical_id", "full_outer")
    outcome = F.when(F.col("_s").isNull(), "not_in_store").when(F.col("_f").isNull(), "not_fetched").when(F.col("lat").isNotNull(), "already_set").when(F.col("_lat").isNull(), "no_location").otherwise("filled")
    place = {c: F.when(F.col("_s"), F.coalesce(c, f"_{c}")).alias(c) for c in ("lat", "lon")}
    return d.select("canonical_id", F.when(F.col("_s"), F.col("species")).otherwise(F.col("_species")).alias("species"), *place.values(), outcome.alias("outcome"))


def delta_refresh(held: DataFrame, store: DataFrame) -> DataFrame:
    """The held rows after reading only what the store has seen since; the latest row of an id wins."""
    mark = held.agg(F.max("last_seen").alias("_mark"))
    delta = store.crossJoin(F.broadcast(mark)).where("last_seen > _mark").drop("_mark")  # one row
    w = Window.partitionBy("canonical_id").orderBy(F.col("last_seen").desc())
    return held.unionByName(delta).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of_feed(records: DataFrame, order: str) -> DataFrame:
    """Of the rows of one animal in a feed the first."""
    w = Window.partitionBy("source_name", "source_animal_id").orderBy(order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attribute_duplicates(records: DataFrame) -> DataFrame:
    """Groups of records alike in species, breed, sex, age, shelter and day of intake, with their size; null counts as a value."""
    day = F.col("intake_date").cast("date").cast("string").alias("day")
    return records.groupBy("species", "breed_primary", "sex", "age_bucket", "city_county", day).agg(F.count("*").alias("n")).where("n > 1")
