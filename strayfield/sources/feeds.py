"""Feeds of five shapes to the canonical intake record. Each works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.geo import coarsen

PHOTO = "array<struct<url:string,attribution:string,is_primary:boolean>>"
COLUMNS = ["source_name", "source_animal_id", "species", "breed_primary", "sex", "age_bucket", "size", "colors", "intake_type", "availability", "chip_status", "found_location_text", "lat", "lon", "city_county", "state", "photos", "first_seen", "last_seen", "last_confirmed", "intake_date", "outcome_date"]


def canonical(df: DataFrame, **given: Column) -> DataFrame:
    """Select the canonical columns; those not given are null, or empty lists."""
    empty = {"colors": F.array().cast("array<string>"), "photos": F.array().cast(PHOTO)}
    times = {"first_seen", "last_seen", "last_confirmed", "intake_date", "outcome_date"}
    kinds = {**dict.fromkeys(times, "timestamp"), "lat": "double", "lon": "double"}
    return df.select(*[(given.get(c, empty.get(c, F.lit(None).cast(kinds.get(c, "string"))))).alias(c) for c in COLUMNS])


def _slots(df: DataFrame, columns: dict[str, str], at: Column | None, name: str, now: Column, family: str, fallback: Column | None = None) -> dict[str, Column]:
    """The canonical values of a feed whose columns a map names by slot."""
    own = lambda slot: (at[columns[slot]] if at is not None else F.col(columns[slot])).cast("string") if slot in columns else F.lit(None).cast("string")
    more = {"nested": (True, False), "geojson": (True, True), "flat": (False, False)}[family]
    stamp = lambda slot: parse.timestamp(own(slot), *more)
    intake = stamp("intake_date") if fallback is None else F.coalesce(stamp("intake_date"), fallback)
    seen = F.coalesce(intake, now)
    color = own("color")
    return {
        "source_name": F.lit(name), "source_animal_id": own("animal_id"), "species": parse.species(own("animal_type")), "breed_primary": own("breed"),
        "colors": F.when(color.isNotNull(), F.array(color)).otherwise(F.array().cast("array<string>")), "intake_type": parse.intake_type(own("intake_type"), family),
        "availability": parse.availability(own("outcome_date"), own("kennel_status"), family), "chip_status": parse.chip(own("chip_status"), family), "found_location_text": own("found_location"),
        "first_seen": seen, "last_seen": seen, "last_confirmed": now, "intake_date": intake, "outcome_date": stamp("outcome_date"), "_raw_intake": own("intake_type"),
    }


def split_rejected(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a known species, rows to reject)."""
    return d.where("species is not null"), d.where("species is null")


def normalize_mapped(df: DataFrame, columns: dict[str, str], name: str, now: Column) -> DataFrame:
    """Flat rows whose column names come from a map. Rows of unknown species have a null one."""
    got = _slots(df, columns, None, name, now, "flat")
    got.pop("_raw_intake")
    return canonical(df, **got)


def normalize_nested(df: DataFrame, columns: dict[str, str], name: str, now: Column) -> DataFrame:
    """Pages of results with record.fields; only strays, whatever their species; the record's own timestamp stands in for the intake date."""
    d = df.select(F.explode("results").alias("r"))
    got = _slots(d, columns, F.col("r.record.fields"), name, now, "nested", parse.timestamp(F.col("r.record.timestamp"), True))
    d = d.where(parse.is_stray(got.pop("_raw_intake")))
    return canonical(d, **got)


def normalize_geojson(df: DataFrame, columns: dict[str, str], name: str, now: Column) -> DataFrame:
    """Feature collections: one row per stray feature, from its properties; dates are ISO or milliseconds."""
    d = df.select(F.explode("features.properties").alias("p"))
    got = _slots(d, columns, F.col("p"), name, now, "geojson")
    d = d.where(parse.is_stray(got.pop("_raw_intake")))
    return canonical(d, **got)


def normalize_jsonapi(df: DataFrame, now: Column) -> DataFrame:
    """Pages of data and included: references are looked up in the page's own included list, in their order; no join."""
    key = lambda x: F.concat_ws("/", x["type"], x["id"])
    index = F.map_from_entries(F.transform(F.array_distinct("included"), lambda x: F.struct(key(x), x["attributes"])))
    d = df.withColumn("_index", index).select("species", "_index", F.explode("data").alias("a"))

    def resolved(refs: Column, field: str) -> Column:
        found = F.transform(F.coalesce(refs, F.array().cast("array<struct<type:string,id:string>>")), lambda r: F.try_element_at(F.col("_index"), key(r))[field])
        return F.filter(found, lambda x: x.isNotNull())

    # the first place that is there counts, locations before organisations; without a name it is none, and places are kept to two digits
    empty = F.array().cast("array<struct<type:string,id:string>>")
    refs = F.concat(F.coalesce("a.relationships.locations", empty), F.coalesce("a.relationships.orgs", empty))
    spot = F.get(F.filter(F.transform(refs, lambda r: F.try_element_at(F.col("_index"), key(r))), lambda x: x.isNotNull()), 0)
    d = d.withColumn("_spot", spot)
    city, state = F.nullif(F.col("_spot.city"), F.lit("")), F.nullif(F.col("_spot.state"), F.lit(""))
    named = F.coalesce(city, state)
    coarse = lambda c: F.when(named.isNotNull(), coarsen(F.col(f"_spot.{c}"), 2))
    stamp = lambda c: parse.timestamp(F.col(c))
    seen = F.coalesce(stamp("a.attributes.updatedDate"), now)
    photos = F.transform(resolved(F.col("a.relationships.pictures"), "url"), lambda u, i: F.struct(u.alias("url"), F.lit("rescuegroups").alias("attribution"), (i == 0).alias("is_primary")))
    return canonical(
        d, source_name=F.lit("rescuegroups"), source_animal_id=F.col("a.id"), species=F.col("species"), breed_primary=F.coalesce("a.attributes.breedPrimary", "a.attributes.breedString"),
        sex=parse.sex(F.col("a.attributes.sex")), age_bucket=parse.age(F.col("a.attributes.ageString"), False), size=parse.size(F.col("a.attributes.sizeGroup"), False),
        colors=resolved(F.col("a.relationships.colors"), "name"), intake_type=F.lit("adoptable"), availability=F.lit("adoptable"), chip_status=F.lit("unknown"), photos=photos.cast(PHOTO),
        first_seen=F.coalesce(stamp("a.attributes.createdDate"), seen), last_seen=seen, last_confirmed=now, lat=coarse("lat"), lon=coarse("lon"), city_county=named, state=state,
    )


def normalize_community(df: DataFrame, now: Column) -> DataFrame:
    """Lost and found reports of a community feed."""
    d = df.select(F.explode("reports").alias("r"))
    lost = F.col("r.type") == "lost"
    name = F.when(F.lower("r.source").isin("helpinglostpets", "help"), "helpinglostpets").otherwise("petfbi")
    event = F.coalesce(parse.timestamp(F.coalesce("r.date_lost", "r.date_found")), now)
    photo = F.struct(F.col("r.photo_url").alias("url"), F.concat(F.lit("© "), name).alias("attribution"), F.lit(True).alias("is_primary"))
    place = F.nullif(F.concat_ws(", ", "r.city", "r.state"), F.lit(""))
    return canonical(
        d, source_name=name, source_animal_id=F.col("r.id"), species=parse.species(F.col("r.species")), breed_primary=F.col("r.breed"), sex=parse.sex(F.col("r.sex")), age_bucket=parse.age(F.col("r.age"), True), size=parse.size(F.col("r.size"), True),
        colors=F.coalesce("r.colors", F.array().cast("array<string>")), intake_type=F.when(lost, "lost_report").otherwise("found_report"), availability=F.when(lost, "missing").otherwise("available"), chip_status=F.lit("unknown"),
        found_location_text=place, photos=F.when(F.col("r.photo_url").isNotNull(), F.array(photo)).otherwise(F.array().cast(PHOTO)).cast(PHOTO), first_seen=F.coalesce(parse.timestamp(F.col("r.date_created")), event), last_seen=event, last_confirmed=now,
    )


def read_ndjson(spark, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of JSON lines; blank lines are ignored."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return parse_ndjson(lines, schema)


def parse_ndjson(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    d = lines.withColumn("_j", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return d.where("_j._bad is null").select("_j.*").drop("_bad"), d.where("_j._bad is not null").select("value")


def write_ndjson(df: DataFrame, path: str, limit: int | None = None) -> None:
    (df if limit is None else df.limit(limit)).write.json(path)


def catalog_violations(catalog: DataFrame, required: list[str]) -> DataFrame:
    """(source, field) of required fields that are null or blank."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in required])
    return catalog.select(F.col("source_name").alias("source"), F.explode(pairs).alias("p")).where("p.value is null or trim(p.value) = ''").select("source", "p.field")


def load_gazetteer(lines: DataFrame) -> DataFrame:
    """Lines (n, value) ``kind,name,state,lat,lon``: blank and # lines are skipped, others need five columns; the last of a name or zip wins."""
    d = lines.where("trim(value) <> '' and not startswith(trim(value), '#')").withColumn("p", F.split("value", ","))
    d = d.withColumn("p", F.when(F.size("p") >= 5, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("gazetteer line has too few columns: "), F.col("value")))))
    number = lambda i: F.translate(F.trim(F.col("p")[i]), "−", "-").cast("double")
    kind, name = F.trim(F.col("p")[0]), F.trim(F.col("p")[1])
    d = d.select("n", kind.alias("kind"), F.lower(name).alias("name"), F.upper(F.trim(F.col("p")[2])).alias("state"), number(3).alias("lat"), number(4).alias("lon"), F.when(kind == "Z", name).alias("zip"))
    return d.groupBy("kind", "name", "state", "zip").agg(F.max_by("lat", "n").alias("lat"), F.max_by("lon", "n").alias("lon"))


def eval_samples(paths: DataFrame) -> DataFrame:
    """(path, species, individual_id) of image paths ``.../<species>/<individual>/<image>``; other files are left out."""
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+\.(?i:jpg|jpeg|png|webp)$", k)
    return paths.where(part(1) != "").select("path", part(1).alias("species"), part(2).alias("individual_id"))


def read_labels(spark, path: str) -> DataFrame:
    """(individual_id, image_path, species, role, created, gap_days) of a labels file in JSON lines; lines without an individual or a path are left out."""
    good, _ = read_ndjson(spark, path, "individual_id string, image_path string, species string, role string, created string, gap_days bigint")
    return good.where("individual_id is not null and image_path is not null")


def read_holes(spark, path: str) -> DataFrame:
    """(lat, lon, radius_km, missed, label) of a file of coverage holes: a JSON array of objects. An object without a place is left out."""
    d = spark.read.schema("lat double, lon double, radius_km double, estimated_missed_population bigint, label string").option("multiLine", True).json(path)
    return d.where("lat is not null and lon is not null").select("lat", "lon", "radius_km", F.coalesce("estimated_missed_population", F.lit(0)).alias("missed"), "label")


def read_ledger(spark, path: str) -> DataFrame:
    """(alert_id, report_id, deliverer, outcome, ts) of a delivery ledger in JSON lines; lines that don't parse are skipped."""
    good, _ = read_ndjson(spark, path, "alert_id string, report_id string, deliverer string, outcome string, ts string")
    return good.where("alert_id is not null and outcome is not null")


def id_map_counts(files: DataFrame) -> DataFrame:
    """(doc, pairs): how many entries an id map in JSON, an array of pairs, has."""
    return files.select("doc", F.size(F.from_json("json", "array<array<string>>")).cast("bigint").alias("pairs"))


def united(feeds: list[DataFrame]) -> DataFrame:
    """Normalised feeds as one table; columns that one lacks are null there."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
