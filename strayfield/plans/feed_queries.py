"""Queries over feeds, files, places and catalogues. The feeds' JSON is made from the events and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover, geocode
from ..sources import feeds
from .registry import query
from .views import NOW_TEXT

FLAT = """SELECT event_id, CAST(event_id AS STRING) AS animal_id, CASE event_id % 50 WHEN 0 THEN 'bird' WHEN 1 THEN NULL ELSE CASE WHEN user_id % 2 = 0 THEN ' Dog' ELSE 'feline' END END AS animal_type,
CASE event_type WHEN 'error' THEN 'STRAY' WHEN 'click' THEN 'FOUND REPORT' WHEN 'signup' THEN 'OWNER SURRENDER' WHEN 'view' THEN 'STRAY INCOMING' ELSE 'TRANSFER' END AS intake_type,
CASE event_id % 4 WHEN 0 THEN '2024-01-05T10:20:30' WHEN 1 THEN '2024-01-05 10:20:30' WHEN 2 THEN '2024-01-05' ELSE 'soon' END AS datetime,
CASE event_id % 5 WHEN 0 THEN 'Adopted' WHEN 1 THEN 'Available' WHEN 2 THEN 'Unavailable' END AS kennel_status, CASE event_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO CHIP' END AS chip_status,
CASE event_id % 6 WHEN 0 THEN NULL ELSE 'Black' END AS color, CASE event_id % 9 WHEN 0 THEN '2024-01-09' END AS outcome_datetime, ts FROM ev"""
FLAT_DUCK = FLAT.replace("AS STRING", "AS VARCHAR")
MAP = {"animal_id": "animal_id", "animal_type": "animal_type", "intake_type": "intake_type", "intake_date": "datetime", "kennel_status": "kennel_status", "chip_status": "chip_status", "color": "color", "outcome_date": "outcome_datetime"}
SEEN = f"epoch_us(CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-05 10:20:30' WHEN 1 THEN TIMESTAMP '2024-01-05 10:20:30' WHEN 2 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE {{}} END)"
SPECIES = "CASE upper(trim(animal_type)) WHEN 'DOG' THEN 'dog' WHEN 'FELINE' THEN 'cat' END"
AVAIL = "CASE WHEN outcome_datetime IS NOT NULL OR kennel_status = 'Adopted' THEN 'departed' WHEN kennel_status IN ('Available', 'Unavailable') THEN 'adoptable' ELSE 'in_custody' END"
CHIP = "CASE event_id % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'scan_no_chip' ELSE 'unknown' END"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def flat(t):
    return t.spark.sql(FLAT.replace("FROM ev", "FROM {ev}"), ev=t.ev)


def shown(d, *more):
    return d.select("source_animal_id", "species", "intake_type", "availability", "chip_status", F.array_join("colors", ",").alias("colors"), F.unix_micros("last_seen").alias("last_seen"), *more)


@query(f"""SELECT animal_id AS source_animal_id, {SPECIES} AS species, CASE intake_type WHEN 'STRAY' THEN 'stray' WHEN 'FOUND REPORT' THEN 'found_report' WHEN 'OWNER SURRENDER' THEN 'owner_surrender' WHEN 'TRANSFER' THEN 'transfer' ELSE 'unknown' END AS intake_type,
{AVAIL} AS availability, {CHIP} AS chip_status, coalesce(color, '') AS colors, {SEEN.format("TIMESTAMP '" + NOW_TEXT + "'")} AS last_seen FROM ({FLAT_DUCK}) WHERE {SPECIES} IS NOT NULL""")
def normalize_mapped(t):
    return shown(normalized_flat(t))


def normalized_flat(t):
    return feeds.split_rejected(feeds.normalize_mapped(flat(t), MAP, "austin", now()))[0]


@query(f"""SELECT animal_id AS source_animal_id, {SPECIES} AS species, CASE intake_type WHEN 'STRAY' THEN 'stray' WHEN 'FOUND REPORT' THEN 'found_report' ELSE 'unknown' END AS intake_type,
{AVAIL} AS availability, {CHIP} AS chip_status, coalesce(color, '') AS colors, {SEEN.format("date_trunc('second', ts)")} AS last_seen FROM ({FLAT_DUCK}) WHERE {SPECIES} IS NOT NULL AND intake_type IN ('STRAY', 'FOUND REPORT', 'STRAY INCOMING')""")
def normalize_nested(t):
    fields = "animal_id string, animal_type string, intake_type string, datetime string, kennel_status string, chip_status string, color string, outcome_datetime string"
    record = F.struct(F.col("animal_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(*[c.split()[0] for c in fields.split(", ")]).alias("fields"))
    pages = flat(t).groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(record.alias("record"))).alias("results"))).alias("json"))
    parsed = pages.select(F.from_json("json", f"results array<struct<record:struct<id:string,timestamp:string,fields:struct<{fields.replace(' string', ':string')}>>>>").alias("j")).select("j.*")
    good, _ = feeds.split_rejected(feeds.normalize_nested(parsed, MAP, "nested", now()))
    return shown(good)


@query(f"""SELECT animal_id AS source_animal_id, {SPECIES} AS species, CASE intake_type WHEN 'FOUND REPORT' THEN 'found_report' ELSE 'stray' END AS intake_type,
'in_custody' AS availability, 'unknown' AS chip_status, coalesce(color, '') AS colors, CASE WHEN event_id % 2 = 0 THEN CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000 ELSE {SEEN.format("TIMESTAMP '" + NOW_TEXT + "'")} END AS last_seen FROM ({FLAT_DUCK}) WHERE {SPECIES} IS NOT NULL AND intake_type IN ('STRAY', 'FOUND REPORT', 'STRAY INCOMING')""")
def normalize_geojson(t):
    date = F.when(F.col("event_id") % 2 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.col("datetime"))
    props = F.struct(F.col("animal_id").alias("AnimalID"), F.col("animal_type").alias("Species"), F.col("intake_type").alias("IntakeType"), date.alias("IntakeDate"), F.col("color").alias("Color"))
    pages = flat(t).groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(props.alias("properties"))).alias("features"))).alias("json"))
    parsed = pages.select(F.from_json("json", "features array<struct<properties:struct<AnimalID:string,Species:string,IntakeType:string,IntakeDate:string,Color:string>>>").alias("j")).select("j.*")
    columns = {"animal_id": "AnimalID", "animal_type": "Species", "intake_type": "IntakeType", "intake_date": "IntakeDate", "color": "Color"}
    good, _ = feeds.split_rejected(feeds.normalize_geojson(parsed, columns, "geo", now()))
    return shown(good)


ONE = "struct<type:string,id:string>"
JSONAPI = (
    "data array<struct<id:string,attributes:struct<sex:string,ageString:string,sizeGroup:string,breedPrimary:string,breedString:string,updatedDate:string,createdDate:string>,"
    f"relationships:struct<colors:array<{ONE}>,pictures:array<{ONE}>,locations:array<{ONE}>,orgs:array<{ONE}>>>>, "
    "included array<struct<type:string,id:string,attributes:struct<name:string,url:string,city:string,state:string,lat:double,lon:double>>>"
)


def normalized_jsonapi(t):
    """Pages of a hundred animals. One in five has no location but an organisation, one in seven a location that isn't included."""
    n = F.col("event_id")
    ref = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("string").alias("id"))
    even = n % 2 == 0
    attributes = F.struct(F.when(n % 3 == 0, "Beagle").alias("breedPrimary"), F.when(n % 3 == 1, "Mixed").alias("breedString"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedDate"))
    relations = F.struct(
        F.when(even, F.array(ref("colors", F.lit(1)), ref("colors", F.lit(2)))).otherwise(F.array(ref("colors", F.lit(2)), ref("colors", F.lit(9)))).alias("colors"),
        F.when(even, F.array(ref("pictures", n))).alias("pictures"),
        F.when(n % 5 > 0, F.array(ref("locations", F.when(n % 7 == 0, F.lit(99)).otherwise(n % 4)))).alias("locations"),
        F.when(n % 5 == 0, F.array(ref("orgs", F.lit(5)))).alias("orgs"),
    )
    animal = F.struct(n.cast("string").alias("id"), attributes.alias("attributes"), relations.alias("relationships"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def item(kind, i, name=text, url=text, city=text, state=text, lat=number, lon=number):
        own = {"name": name, "url": url, "city": city, "state": state, "lat": lat, "lon": lon}
        return F.struct(F.lit(kind).alias("type"), i.cast("string").alias("id"), F.struct(*[v.alias(k) for k, v in own.items()]).alias("attributes"))

    url = F.concat(F.lit("https://img.example/"), n.cast("string"), F.lit(".jpg"))
    w = F.lit
    fixed = F.array(
        item("colors", w(1), w("Black")), item("colors", w(2), w("Tan")), item("locations", w(0), city=w("Austin"), state=w("TX"), lat=w(30.267), lon=w(-97.743)), item("locations", w(1), city=w(""), state=w("CA"), lat=w(34.0), lon=w(-118.25)),
        item("locations", w(2), lat=w(1.0), lon=w(2.0)), item("locations", w(3), city=w("Nowhere")), item("orgs", w(5), city=w("Dallas"), state=w("TX"), lat=w(32.78), lon=w(-96.8)),
    )
    pages = t.ev.groupBy(F.floor(n / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(animal).alias("data"), F.concat(fixed, F.collect_list(item("pictures", n, url=url))).alias("included"))).alias("json"))
    return feeds.normalize_jsonapi(pages.select(F.from_json("json", JSONAPI).alias("j")).select("j.*", F.lit("dog").alias("species")), now())


SPOT = "CASE WHEN event_id % 5 = 0 THEN 5 WHEN event_id % 7 = 0 THEN 99 ELSE event_id % 4 END"


@query(f"""SELECT CAST(event_id AS VARCHAR) AS source_animal_id, 'dog' AS species, CASE event_id % 3 WHEN 0 THEN 'Beagle' WHEN 1 THEN 'Mixed' END AS breed_primary, CASE event_id % 2 WHEN 0 THEN 'Black,Tan' ELSE 'Tan' END AS colors,
CASE event_id % 2 WHEN 0 THEN 'https://img.example/' || event_id || '.jpg' ELSE '' END AS photo, floor(epoch(ts)) * 1000000 AS last_seen, CASE {SPOT} WHEN 0 THEN 'Austin' WHEN 1 THEN 'CA' WHEN 3 THEN 'Nowhere' WHEN 5 THEN 'Dallas' END AS city_county,
CASE {SPOT} WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' WHEN 5 THEN 'TX' END AS state, CAST(CASE {SPOT} WHEN 0 THEN 30.27 WHEN 1 THEN 34.0 WHEN 5 THEN 32.78 END AS DOUBLE) AS lat, CAST(CASE {SPOT} WHEN 0 THEN -97.74 WHEN 1 THEN -118.25 WHEN 5 THEN -96.8 END AS DOUBLE) AS lon FROM ev""")
def normalize_jsonapi(t):
    colors, photo = F.array_join("colors", ",").alias("colors"), F.coalesce(F.get("photos", 0)["url"], F.lit("")).alias("photo")
    return normalized_jsonapi(t).select("source_animal_id", "species", "breed_primary", colors, photo, F.unix_micros("last_seen").cast("double").alias("last_seen"), "city_county", "state", "lat", "lon")


@query("""SELECT CAST(event_id AS VARCHAR) AS source_animal_id, CASE WHEN user_id % 2 = 0 THEN 'dog' ELSE 'cat' END AS species, CASE WHEN k % 2 = 0 THEN 'helpinglostpets' ELSE 'petfbi' END AS source_name,
CASE WHEN event_type = 'view' THEN 'lost_report' ELSE 'found_report' END AS intake_type, CASE WHEN event_type = 'view' THEN 'missing' ELSE 'available' END AS availability,
CASE event_id % 3 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'TX' END AS found_location_text, CASE WHEN k % 3 = 0 THEN '© ' || CASE WHEN k % 2 = 0 THEN 'helpinglostpets' ELSE 'petfbi' END ELSE '' END AS attribution FROM ev""")
def normalize_community(t):
    d = normalized_community(t)
    return d.select("source_animal_id", "species", "source_name", "intake_type", "availability", "found_location_text", F.coalesce(F.get("photos", 0)["attribution"], F.lit("")).alias("attribution"))


def normalized_community(t):
    text = F.lit(None).cast("string")
    r = F.struct(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "lost").otherwise("found").alias("type"), F.when(F.col("k") % 2 == 0, "Help").otherwise("pfb").alias("source"), F.when(F.col("user_id") % 2 == 0, "dog").otherwise("Cat").alias("species"),
        text.alias("breed"), text.alias("sex"), text.alias("age"), text.alias("size"), F.array(F.lit("Tan")).alias("colors"), F.when(F.col("k") % 3 == 0, "https://img.example/x.jpg").alias("photo_url"), F.when(F.col("event_id") % 3 == 0, "Austin").alias("city"),
        F.when(F.col("event_id") % 3 < 2, "TX").alias("state"), text.alias("date_lost"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_found"), text.alias("date_created"),
    )
    return feeds.normalize_community(t.ev.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(r).alias("reports")), now())


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def ndjson_scan(t):
    """JSON lines with malformed and blank ones among them."""
    value = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 11 == 0, "  ").otherwise(F.to_json(F.struct("event_id", "event_type")))
    good, _ = feeds.parse_ndjson(t.events.select(value.alias("value")).where("trim(value) <> ''"), "event_id bigint, event_type string")
    return good


@query("SELECT lower(name) AS name, state, kind, lat, lon, zip FROM v_gazetteer")
def gazetteer_load(t):
    """CSV lines, each place once stale and once current; the later line wins."""
    g = t.v_gazetteer
    line = lambda shift: F.concat_ws(",", "kind", "name", "state", (F.col("lat") + shift).cast("string"), F.regexp_replace((F.col("lon")).cast("string"), "-", "−"))
    lines = g.select(F.lit(1).alias("n"), line(1).alias("value")).unionAll(g.select(F.lit(2), line(0))).unionAll(g.limit(3).select(F.lit(3), F.lit("# note")))
    return feeds.load_gazetteer(lines)


@query("SELECT source_name AS source, 'metro' AS field FROM v_catalog WHERE source_name IN ('src1', 'src3') UNION ALL SELECT source_name, 'domain' FROM v_catalog WHERE source_name IN ('src2', 'src3')")
def catalog_validate(t):
    c = t.v_catalog.select("source_name", F.when(F.col("source_name").isin("src1", "src3"), " ").otherwise(F.col("metro")).alias("metro"), F.when(~F.col("source_name").isin("src2", "src3"), "data.example").alias("domain"))
    return feeds.catalog_violations(c, ["metro", "domain"])


PLACE = """SELECT place_id, CASE place_id % 6 WHEN 0 THEN place_text END AS zip, CASE WHEN place_id % 6 IN (1, 2) THEN regexp_extract(lower(place_text), 'nation_[0-9]+') END AS city, CASE WHEN place_id % 6 IN (1, 2) THEN 'TX' END AS state FROM v_place_text"""


@query(PLACE)
def parse_place_text(t):
    from ..functions.parse import place

    p = place(F.col("place_text"))
    return t.v_place_text.select("place_id", p["zip"].alias("zip"), p["city"].alias("city"), p["state"].alias("state"))


@query(f"""WITH p AS ({PLACE}) SELECT place_id, CASE WHEN place_id % 8 = 1 THEN 1.5 ELSE coalesce(z.lat, c.lat) END AS lat, CASE WHEN place_id % 8 = 1 THEN 2.5 ELSE coalesce(z.lon, c.lon) END AS lon,
CASE WHEN place_id % 8 = 1 THEN 'already_set' WHEN coalesce(z.lat, c.lat) IS NULL THEN 'not_resolved' ELSE 'filled' END AS outcome, CASE WHEN place_id % 8 <> 1 AND coalesce(z.lat, c.lat) IS NOT NULL THEN 'found_text' END AS located_by
FROM p LEFT JOIN (SELECT * FROM v_gazetteer WHERE kind = 'Z') z ON p.zip = z.zip LEFT JOIN (SELECT * FROM v_gazetteer WHERE kind = 'P') c ON p.city = lower(c.name) AND p.state = c.state""")
def geocode_places(t):
    """One place in eight has coordinates, which stay."""
    known = F.col("place_id") % 8 == 1
    rows = t.v_place_text.withColumns({"lat": F.when(known, 1.5), "lon": F.when(known, 2.5)})
    return geocode.geocode(rows, t.v_gazetteer).select("place_id", "lat", "lon", "outcome", "located_by")


TEXT = "lower(title || ' ' || description)"
POINTS = "CASE " + " ".join(f"WHEN contains({TEXT}, '{p}') THEN {n}" for p, n in discover.PHRASES) + " ELSE 0 END"
HAS = lambda words: "len([c for c in columns if regexp_matches(lower(c), '" + "|".join(words) + "')]) > 0"
SCORED = f"SELECT *, {POINTS} + CASE WHEN {HAS(discover.INTAKE_COLUMNS)} THEN 2 ELSE 0 END + CASE WHEN {HAS(discover.ANIMAL_COLUMNS)} THEN 1 ELSE 0 END AS score FROM v_datasets"
SIGNAL = "CASE " + " ".join(f"WHEN contains({TEXT}, '{p}') THEN 'name:{p.replace(' ', '-')}'" for p, _ in discover.PHRASES) + " END"


@query(f"SELECT dataset_id, CAST(score AS INT) AS score, concat_ws(';', {SIGNAL}, CASE WHEN {HAS(discover.INTAKE_COLUMNS)} THEN 'col:intake-type' END, CASE WHEN {HAS(discover.ANIMAL_COLUMNS)} THEN 'col:animal-type' END) AS signals FROM ({SCORED})")
def score_candidates(t):
    return discover.score_candidates(t.v_datasets).select("dataset_id", F.col("score").cast("int").alias("score"), F.array_join("signals", ";").alias("signals"))


@query(f"SELECT domain, dataset_id, CAST(score AS INT) AS score FROM ({SCORED}) WHERE score > 0")
def catalog_candidates(t):
    found = t.v_datasets.unionAll(t.v_datasets.withColumn("term", F.concat("term", F.lit("b"))))
    return discover.catalog_candidates(found).select("domain", "dataset_id", F.col("score").cast("int").alias("score"))


@query(f"""WITH h AS (SELECT *, coalesce(trim(split_part(label, ',', 1)), printf('%.1f', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ' ' || printf('%.1f', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS term,
coalesce(label, printf('%.2f', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ',' || printf('%.2f', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS region FROM v_holes)
SELECT hole, region, dataset_id, CAST(s.score AS INT) AS score FROM h JOIN (SELECT * FROM ({SCORED}) WHERE score > 0) s ON h.term = s.term AND s.family IN ('socrata', 'opendatasoft') ORDER BY missed DESC, s.score DESC, title, dataset_id, hole LIMIT 100""")
def hole_candidates(t):
    return discover.hole_candidates(t.v_holes, t.v_datasets).select("hole", "region", "dataset_id", F.col("score").cast("int").alias("score"))


@query("""SELECT p_partkey AS dataset_id, 'f' || p_size AS field, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'f' || p_size END AS display FROM part""")
def column_metadata(t):
    """Column lists in JSON under both spellings, with system columns."""
    own = F.concat(F.lit("f"), F.col("p_size").cast("string"))
    even = F.col("p_partkey") % 2 == 0
    items = F.array(F.struct(F.when(even, own).alias("fieldName"), F.when(~even, own).alias("field_name"), F.when(even, F.col("p_name")).alias("name")), F.struct(F.lit(":id").alias("fieldName"), F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("name")))
    lines = t.part.select(F.col("p_partkey").alias("dataset_id"), F.to_json(items).alias("json"))
    return discover.column_metadata(lines).select("dataset_id", "field", "display")


#: What the six column lists of the view map to, slot by slot.
MAPS = {
    0: {"animal_id": "animal_id", "animal_type": "animal_type", "intake_type": "intake_type", "intake_date": "intake_date", "breed": "breed", "color": "color"},
    1: {"animal_id": "AnimalID", "animal_type": "Species", "intake_type": "Entry_Reason", "kennel_status": "Status", "name": "name"},
    2: {"animal_id": "id", "animal_type": "type", "found_location": "found_location"},
    3: {"animal_id": "record_id", "animal_type": "species", "intake_date": "datetime", "chip_status": "microchip_no", "outcome_date": "outcome_date"},
    4: {},
    5: {"animal_id": "animal_number", "animal_type": "animal_type", "intake_type": "intake_subtype", "kennel_status": "custody_status", "name": "pet_name"},
}
ROWS = ", ".join(f"({k}, '{s}', '{c}')" for k, m in MAPS.items() for s, c in m.items())


@query(f"SELECT dataset_id, slot, col AS \"column\" FROM v_datasets JOIN (VALUES {ROWS}) AS m(k, slot, col) ON dataset_id % 6 = k")
def infer_column_map(t):
    return discover.infer_column_map(t.v_datasets)


@query(f"""WITH m AS (SELECT k, max(CASE WHEN slot = 'intake_type' THEN 1 ELSE 0 END) AS i, max(CASE WHEN slot = 'animal_type' THEN 1 ELSE 0 END) AS a, max(CASE WHEN slot = 'animal_id' THEN 1 ELSE 0 END) AS d FROM (VALUES {ROWS}) AS m(k, slot, col) GROUP BY k),
r AS (SELECT dataset_id, CASE WHEN coalesce(d, 0) = 0 THEN 'no animal_id' WHEN a = 0 THEN 'no animal_type' WHEN i = 0 THEN 'no intake_type' WHEN dataset_id % 4 NOT IN (0, 2) THEN 'no stray value in sample' ELSE 'required columns with confirmed stray values' END AS reason FROM v_datasets LEFT JOIN m ON dataset_id % 6 = k)
SELECT dataset_id, CASE WHEN reason LIKE 'required%' THEN 'GREEN' ELSE 'RED' END AS verdict, reason FROM r""")
def probe_verdict(t):
    from ..functions.parse import is_stray

    return discover.probe_verdict(t.v_datasets, is_stray(F.col("sample_intake")))


@query("SELECT i // 2 AS doc, count(*) AS pairs FROM (SELECT vec_id AS i FROM embeddings) GROUP BY 1")
def id_map_count(t):
    """Entries of an id map, a JSON array of pairs per file, counted as list entries."""
    pairs = t.embeddings.select((F.floor(F.col("vec_id") / 2)).alias("doc"), F.array(F.col("vec_id").cast("string"), F.lit("dog")).alias("p"))
    files = pairs.groupBy("doc").agg(F.to_json(F.collect_list("p")).alias("json"))
    return feeds.id_map_counts(files)
