"""Finding feeds: relevance of catalogue rows, holes to look at, and the mapping of a dataset's columns to slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases with their scores, the first that is found counts; and the column names that add to them.
PHRASES = [("animal intake", 4), ("animal services", 3), ("shelter intake", 3), ("stray", 3), ("shelter", 2), ("animal control", 2), ("animal", 1), ("intake", 1)]
INTAKE_COLUMNS = ["intake_type", "intaketype", "intake_subtype", "intake_condition", "entry_reason"]
ANIMAL_COLUMNS = ["animal_type", "animaltype", "species"]
#: The slots of a column map in order, with the column names that fit each, best first.
SLOTS = {
    "animal_id": ["animal_id", "animalid", "animal_number", "id"],
    "animal_type": ["animal_type", "animaltype", "species", "type"],
    "intake_type": ["intake_type", "intaketype", "intake_subtype", "intake_condition", "entry_reason"],
    "intake_date": ["intake_date", "intakedate", "datetime", "intake_datetime", "date_intake", "entry_date"],
    "found_location": ["found_location", "foundlocation", "location_found", "found_address", "where_found"],
    "chip_status": ["chip_status", "chipstatus", "microchip", "chip"],
    "kennel_status": ["kennel_status", "kennelstatus", "status", "custody_status"],
    "breed": ["breed", "primary_breed", "breed_primary"],
    "name": ["name", "animal_name", "pet_name"],
    "color": ["color", "colour", "primary_color"],
    "outcome_date": ["outcome_date", "outcomedate", "outcome_datetime", "date_outcome"],
}


def score_candidates(rows: DataFrame) -> DataFrame:
    """Add score and signals to catalogue rows (title, description, columns)."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    points, signal = F.lit(0), F.lit(None).cast("string")
    for phrase, n in reversed(PHRASES):
        points = F.when(text.contains(phrase), n).otherwise(points)
        signal = F.when(text.contains(phrase), "name:" + phrase.replace(" ", "-")).otherwise(signal)
    has = lambda names: F.exists("columns", lambda c: F.lower(c).rlike("|".join(names)))
    i, a = has(INTAKE_COLUMNS), has(ANIMAL_COLUMNS)
    signals = F.array_compact(F.array(signal, F.when(i, "col:intake-type"), F.when(a, "col:animal-type")))
    return rows.withColumns({"score": points + F.when(i, 2).otherwise(0) + F.when(a, 1).otherwise(0), "signals": signals})


def compass(x: Column, pattern: str, plus: str, minus: str) -> Column:
    return F.concat(F.format_string(pattern, F.abs(x)), F.when(x >= 0, plus).otherwise(minus))


def hole_terms(holes: DataFrame) -> DataFrame:
    """Add the query term of a hole (its label up to a comma, else a compass label) and its region's name."""
    term = F.coalesce(F.trim(F.substring_index("label", ",", 1)), F.concat_ws(" ", compass(F.col("lat"), "%.1f", "N", "S"), compass(F.col("lon"), "%.1f", "E", "W")))
    region = F.coalesce("label", F.concat_ws(",", compass(F.col("lat"), "%.2f", "N", "S"), compass(F.col("lon"), "%.2f", "E", "W")))
    return holes.withColumns({"term": term, "region": region})


def hole_candidates(holes: DataFrame, rows: DataFrame, top: int = 100, families: tuple[str, ...] = ("socrata", "opendatasoft")) -> DataFrame:
    """Relevant catalogue rows of each hole's term in each of the families: most missed first, then by score and title."""
    asked = hole_terms(holes).withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    d = asked.join(score_candidates(rows).where("score > 0"), ["term", "family"])
    return d.orderBy(F.col("missed").desc(), F.col("score").desc(), "title", "dataset_id", "hole").limit(top)


def catalog_candidates(rows: DataFrame) -> DataFrame:
    """One row per (domain, dataset): the first term that found it; rows of score 0 are dropped."""
    w = Window.partitionBy("domain", "dataset_id").orderBy("term")
    return score_candidates(rows).where("score > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def column_metadata(lines: DataFrame, json: str = "json") -> DataFrame:
    """(dataset_id, field, display) of column lists in JSON, under either spelling; system columns, which start with a colon, are dropped."""
    kind = "array<struct<fieldName:string,field_name:string,name:string>>"
    d = lines.select("dataset_id", F.posexplode(F.from_json(json, kind)).alias("pos", "c")).withColumn("field", F.coalesce("c.fieldName", "c.field_name"))
    return d.where("field is not null and not startswith(field, ':')").select("dataset_id", "pos", "field", F.coalesce("c.name", "field").alias("display"))


def _named(word: str):
    return lambda c: F.lower(c) == word


def _containing(word: str):
    return lambda c: F.contains(F.lower(c), F.lit(word))


def _other_than(column: str):
    return lambda c: ~F.coalesce(c == F.col(column), F.lit(False))


def column_claims(datasets: DataFrame) -> DataFrame:
    """``datasets`` with a column ``_<slot>`` for each slot: the best column that none before it has claimed, by exact name before contained name, in keyword then column order.

    A dataset's columns are one array, so the claims are eleven steps of array functions in a row; nothing is shuffled.
    """
    d = datasets.withColumn("_free", F.filter("columns", lambda c: ~F.startswith(c, F.lit(":"))))
    for slot, words in SLOTS.items():
        tries = [F.filter("_free", _named(w)) for w in words] + [F.filter("_free", _containing(w)) for w in words]
        d = d.withColumn(f"_{slot}", F.coalesce(*[F.get(x, 0) for x in tries]))
        d = d.withColumn("_free", F.filter("_free", _other_than(f"_{slot}")))
    return d.drop("_free")


def infer_column_map(datasets: DataFrame) -> DataFrame:
    """(dataset_id, slot, column): the claims of each dataset as rows."""
    found = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"_{s}").alias("column")) for s in SLOTS])
    return column_claims(datasets.select("dataset_id", "columns")).select("dataset_id", F.explode(found).alias("m")).where("m.column is not null").select("dataset_id", "m.slot", "m.column")


def probe_verdict(datasets: DataFrame, stray: Column) -> DataFrame:
    """(dataset_id, verdict, reason): green if id, animal and intake columns are there and the sample row shows a stray. Row by row, without a shuffle."""
    reason = F.when(F.col("_animal_id").isNull(), "no animal_id").when(F.col("_animal_type").isNull(), "no animal_type").when(F.col("_intake_type").isNull(), "no intake_type").when(~stray, "no stray value in sample").otherwise("required columns with confirmed stray values")
    return column_claims(datasets).select("dataset_id", F.when(F.startswith(reason, F.lit("required")), "GREEN").otherwise("RED").alias("verdict"), reason.alias("reason"))
