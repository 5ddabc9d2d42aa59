"""Deterministic views over the given tables that stand in for feeds, stores, reports and galleries.

Each view is one SQL text for both engines; ``[[...]]`` marks the few places where their dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The clock of every query that needs one, in seconds since 1970 and as text.
NOW, NOW_TEXT = 1706659200, "2024-01-31 00:00:00"

VIEWS = {
    "ev": "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events",
    "v_intake": """
SELECT lpad(CAST(event_id AS [[S]]), 26, '0') AS canonical_id, 'src' || CAST(user_id % 5 AS [[S]]) AS source_name,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id * 10 + event_id % 10 AS [[S]]) END AS source_animal_id,
  CASE WHEN user_id % 2 = 0 THEN 'dog' ELSE 'cat' END AS species,
  CASE event_type WHEN 'signup' THEN 'owner_surrender' WHEN 'error' THEN 'stray' WHEN 'click' THEN 'found_report' WHEN 'view' THEN 'adoptable' ELSE 'transfer' END AS intake_type,
  CASE k % 6 WHEN 0 THEN 'departed' WHEN 1 THEN 'adoptable' WHEN 2 THEN 'unknown' ELSE 'in_custody' END AS availability,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 25 + CAST(event_id * 37 % 2400 AS DOUBLE) / 100 END AS lat,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE -124 + CAST(event_id * 53 % 5700 AS DOUBLE) / 100 END AS lon,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS intake_date, ts AS last_seen,
  [[MINUS_DAYS(ts, k % 5)]] AS first_seen,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS last_confirmed,
  CASE WHEN event_id % 19 = 0 THEN ts ELSE NULL END AS outcome_date,
  CASE k % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE NULL END AS size,
  CASE k % 3 WHEN 0 THEN [[EMPTY]] WHEN 1 THEN [[LIST('Black')]] ELSE [[LIST('white', 'Tan')]] END AS colors,
  CASE event_type WHEN 'signup' THEN 'Labrador Retriever' WHEN 'click' THEN 'Siamese' WHEN 'view' THEN 'Beagle Mix' WHEN 'error' THEN NULL ELSE 'Domestic Shorthair' END AS breed_primary,
  'County ' || CAST(user_id % 7 AS [[S]]) || ' ' || CAST(78700 + user_id % 10 AS [[S]]) AS city_county,
  CASE user_id % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' WHEN 2 THEN 'WA' ELSE NULL END AS state,
  CASE event_id % 3 WHEN 0 THEN [[EMPTY]] WHEN 1 THEN [[LIST('https://img.example/' || CAST(event_id % 997 AS VARCHAR(20)) || '.jpg')]]
    ELSE [[LIST('https://img.example/' || CAST(event_id % 997 AS VARCHAR(20)) || '.jpg', 'https://img.example/' || CAST(event_id % 991 AS VARCHAR(20)) || 'b.jpg')]] END AS photos,
  event_id, user_id, k
FROM ev""",
    "v_lost_report": """
SELECT 'r' || CAST(c_custkey AS [[S]]) AS report_id, CASE WHEN c_custkey % 2 = 0 THEN 'dog' ELSE 'cat' END AS species,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 25 + CAST(c_custkey * 41 % 2400 AS DOUBLE) / 100 END AS lat,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE -124 + CAST(c_custkey * 67 % 5700 AS DOUBLE) / 100 END AS lon,
  CASE c_custkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE NULL END AS size,
  CASE c_custkey % 3 WHEN 0 THEN [[EMPTY]] WHEN 1 THEN [[LIST('black')]] ELSE [[LIST('WHITE')]] END AS colors,
  CASE WHEN c_custkey % 10 = 0 THEN 'reunited' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Breed ' || CAST(c_custkey % 9 AS [[S]]) END AS breed_primary,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Lost near the market; answers to name ' || c_name END AS description,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'City ' || CAST(c_nationkey AS [[S]]) END AS city,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'TX' END AS state,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(78700 + c_custkey % 90 AS [[S]]) END AS zip_code,
  CASE WHEN c_custkey % 9 = 0 THEN [[EMPTY]] WHEN c_custkey % 9 = 1 THEN [[LIST('data:image/jpeg;base64,AAAA')]] ELSE [[LIST('https://img.example/r' || CAST(c_custkey AS VARCHAR(20)) || '.jpg')]] END AS photos,
  [[PLUS_DAYS(TIMESTAMP '2024-01-01 00:00:00', c_custkey % 30)]] AS created,
  [[PLUS_DAYS(TIMESTAMP '2024-01-01 00:00:00', c_custkey % 30 + CASE WHEN c_custkey % 9 = 0 THEN 10 ELSE 90 END)]] AS expires,
  c_custkey AS n, c_name || '@mail.example' AS contact,
  CASE c_custkey % 3 WHEN 0 THEN 'https://hook.example/' || CAST(c_custkey AS [[S]]) WHEN 1 THEN 'ftp://hook.example/' || CAST(c_custkey AS [[S]]) ELSE NULL END AS notify_url
FROM customer""",
    "v_gallery": """
SELECT vec_id, 'a' || CAST(CAST(floor(vec_id / 3) AS BIGINT) AS [[S]]) AS canonical_id, 'i' || CAST(label AS [[S]]) AS individual_id,
  CASE WHEN label % 2 = 0 THEN 'dog' ELSE 'cat' END AS species, embedding FROM embeddings""",
    "v_pairs": "SELECT doc_id, CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS score, quality = 1 AS is_match FROM labels",
    "v_pictures": """
SELECT o_custkey AS animal, CAST(o_orderdate AS TIMESTAMP) AS created, o_orderkey AS picture,
  CASE WHEN o_custkey % 2 = 0 THEN 'dog' ELSE 'cat' END AS species, o_custkey % 40 AS org FROM orders""",
    "v_place_text": """
SELECT s_suppkey AS place_id, CASE s_suppkey % 6 WHEN 0 THEN CAST(10000 + (s_nationkey * 37) AS [[S]]) WHEN 1 THEN 'Near the park, NATION_' || CAST(s_nationkey AS [[S]]) || ', TX'
  WHEN 2 THEN 'NATION_' || CAST(s_nationkey AS [[S]]) || ' tx' WHEN 3 THEN 'somewhere over there' WHEN 4 THEN '' ELSE NULL END AS place_text FROM supplier""",
    "v_gazetteer": """
SELECT 'P' AS kind, n_name AS name, 'TX' AS state, 25 + CAST(n_nationkey * 41 % 240 AS DOUBLE) / 10 AS lat, -124 + CAST(n_nationkey * 67 % 570 AS DOUBLE) / 10 AS lon, CAST(NULL AS [[S]]) AS zip FROM nation
UNION ALL SELECT 'Z', CAST(10000 + n_nationkey * 37 AS [[S]]), 'TX', 26 + CAST(n_nationkey * 43 % 230 AS DOUBLE) / 10, -123 + CAST(n_nationkey * 61 % 560 AS DOUBLE) / 10, CAST(10000 + n_nationkey * 37 AS [[S]]) FROM nation""",
    "v_link": "SELECT source_name, source_animal_id, min(canonical_id) AS canonical_id, max(last_seen) AS link_seen FROM v_intake WHERE source_animal_id IS NOT NULL AND event_id % 3 = 0 GROUP BY source_name, source_animal_id",
    "v_catalog": """
SELECT DISTINCT source_name, 'Metro ' || source_name AS metro, CAST(86400 AS BIGINT) AS cadence FROM v_intake
UNION ALL SELECT 'long_beach', 'Long Beach, CA', 86400 UNION ALL SELECT 'silent_source', 'Houston, TX', 3600""",
    "v_datasets": """
SELECT p_partkey AS dataset_id, CASE p_size % 9 WHEN 0 THEN 'Animal Intake Records' WHEN 1 THEN 'City Animal Services' WHEN 2 THEN 'Shelter Intake log' WHEN 3 THEN 'Stray report' WHEN 4 THEN 'Shelter list'
  WHEN 5 THEN 'Animal Control calls' WHEN 6 THEN 'Animal census' WHEN 7 THEN 'Intake of goods' ELSE p_name END AS title, p_type AS description,
  CASE p_partkey % 6 WHEN 0 THEN [[LIST('animal_id', 'animal_type', 'intake_type', 'intake_date', 'breed', 'color')]] WHEN 1 THEN [[LIST(':id', 'AnimalID', 'Species', 'Entry_Reason', 'Status', 'name')]]
  WHEN 2 THEN [[LIST('id', 'type', 'found_location')]] WHEN 3 THEN [[LIST('record_id', 'species', 'datetime', 'outcome_date', 'microchip_no')]] WHEN 4 THEN [[LIST('street', 'zip')]] ELSE [[LIST('animal_number', 'animal_type', 'intake_subtype', 'custody_status', 'pet_name')]] END AS columns,
  CASE WHEN p_partkey % 4 = 0 THEN 'STRAY' WHEN p_partkey % 4 = 1 THEN 'OWNER SURRENDER' WHEN p_partkey % 4 = 2 THEN 'found report' ELSE NULL END AS sample_intake,
  'dom' || CAST(p_partkey % 3 AS [[S]]) AS domain, 'term' || CAST(p_partkey % 25 AS [[S]]) AS term,
  CASE p_partkey % 7 WHEN 0 THEN 'arcgis' WHEN 1 THEN 'opendatasoft' WHEN 2 THEN 'opendatasoft' ELSE 'socrata' END AS family FROM part""",
    "v_holes": """
SELECT n_nationkey AS hole, 25 + CAST(n_nationkey * 41 % 240 AS DOUBLE) / 10 AS lat, -124 + CAST(n_nationkey * 67 % 570 AS DOUBLE) / 10 AS lon, CAST(n_nationkey % 5 * 1000 AS BIGINT) AS missed,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'term' || CAST(n_nationkey AS [[S]]) || ', TX' END AS label FROM nation""",
    "v_ledger": """
SELECT 'r' || CAST(c_custkey AS [[S]]) AS report_id, lpad(CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS [[S]]), 26, '0') AS candidate_id,
  CASE c_custkey % 4 WHEN 0 THEN 'DryRun' WHEN 1 THEN 'Sent' WHEN 2 THEN 'Failed' ELSE 'Suppressed' END AS outcome FROM customer""",
    "v_enrolled": """
SELECT p.vec_id, i.canonical_id, i.species, p.embedding FROM (SELECT vec_id, CAST(floor(vec_id / 3) AS BIGINT) AS animal, embedding FROM embeddings) p JOIN v_intake i ON i.event_id = p.animal""",
    "v_report_photo": "SELECT r.report_id, r.species, r.status, r.photos, r.notify_url, e.embedding FROM v_lost_report r JOIN embeddings e ON e.vec_id = r.n",
    "v_sync": "SELECT DISTINCT source_name, source_animal_id, [[DAY(last_seen)]] AS sync FROM v_intake WHERE source_animal_id IS NOT NULL",
}


def _dialect(text: str, engine: str) -> str:
    spark = engine == "spark"

    def change(m: re.Match) -> str:
        name, _, args = m[1].partition("(")
        args = args.removesuffix(")")
        first, _, second = args.partition(", ")
        return {
            "S": "STRING" if spark else "VARCHAR",
            "EMPTY": "CAST(array() AS ARRAY<STRING>)" if spark else "CAST([] AS VARCHAR[])",
            "LIST": f"array({args})" if spark else f"[{args}]",
            "MINUS_DAYS": f"{first} - make_dt_interval(CAST({second} AS INT))" if spark else f"{first} - to_days(CAST({second} AS INT))",
            "PLUS_DAYS": f"{first} + make_dt_interval(CAST({second} AS INT))" if spark else f"{first} + to_days(CAST({second} AS INT))",
            "DAY": f"CAST(date_diff(CAST({args} AS DATE), DATE '2024-01-01') AS INT)" if spark else f"CAST(date_diff('day', DATE '2024-01-01', CAST({args} AS DATE)) AS INT)",
        }[name]

    return re.sub(r"\[\[(.*?)\]\]", change, text).replace("VARCHAR(20)", "STRING" if spark else "VARCHAR")


def _uses(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def duckdb_sql(text: str) -> str:
    """``text`` with the views it uses as common table expressions before it."""
    found: list[str] = []

    def add(t: str) -> None:
        for v in _uses(t):
            if v not in found:
                add(VIEWS[v])
                found.append(v)

    add(text)
    if not found:
        return text
    views = ", ".join(f"{v} AS ({_dialect(VIEWS[v], 'duckdb')})" for v in found)
    body = text.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {v: view(spark, sf_dir, v) for v in [*TABLES, *VIEWS] if v != name and re.search(rf"(FROM|JOIN) {v}\b", text)}
    text = re.sub(r"(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in parts else m[0], _dialect(text, "spark"))
    return spark.sql(text, **parts)
