"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The rules of op10.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans", "text_hash")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).drop("text_hash")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(table(spark, sf_dir, "documents")).documents()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS rules(rule, verdict)"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified

    return verified(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .balltree import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_warc, op4_near_duplicates, op5_language_id, op6_pii, op7_token_count, op8_fingerprint, op9_mixing, op10_url_filter, op11_merkle_manifest, op12_simhash, op13_ranked_search)}

#: Of ``s``, the digits of an id: the register of crc32 after them, less its last complement.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLES = {
    "op13_ranked_search": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
d AS (SELECT * FROM t WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
m AS (SELECT row, doc_id, 10 + (90 * CAST(len(w) AS BIGINT) * big_n) // big_l AS m FROM d, c),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE t AS (SELECT *, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
d AS (SELECT doc_id, coalesce(1 || source, '') AS g, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf, sha256({_LEAF} || {_FIELD.format("changed")}) AS tampered FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
up AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM p UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
sub AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS spot, count(*) OVER () AS m FROM (SELECT g, lvl AS depth, h AS subroot FROM up WHERE n = 1)),
top AS (SELECT 0 AS lvl, spot AS pos, subroot AS h, m AS n FROM sub UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
al AS (SELECT g, lvl, pos, h FROM up WHERE n > 1 UNION ALL SELECT s.g, s.depth + top.lvl, top.pos, top.h FROM top, sub s WHERE top.n > 1),
beside AS (SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
  FROM al a JOIN al b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 GROUP BY ALL),
fold AS (SELECT p.doc_id, p.leaf, p.g, s.depth, s.spot, 0 AS lvl, CASE WHEN s.depth = 0 THEN s.spot ELSE p.pos END AS pos, p.tampered AS h, '' AS proof FROM p JOIN sub s USING (g)
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.depth, f.spot, f.lvl + 1, CASE WHEN f.lvl + 1 = f.depth THEN f.spot ELSE f.pos // 3 END, sha256(b.lft || f.h || b.rgt), f.proof || b.lft || b.rgt FROM fold f JOIN beside b ON b.g = f.g AND b.lvl = f.lvl AND b.pos = f.pos),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM fold f JOIN sub s USING (g), root WHERE f.lvl = s.depth + (SELECT max(lvl) FROM top)
""",
    "op1_decontamination": r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
        FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dwin AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS k
         FROM dw, (SELECT DISTINCT l FROM win) AS x, unnest(range(1, len(w) - l + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, l FROM dwin JOIN win USING (l, k)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
""",
    "op10_url_filter": r"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages),
hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT h.*, (SELECT struct_pack(r := rh || rp, v := v) FROM rules
               WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
               ORDER BY length(rh || rp) DESC LIMIT 1) AS b
  FROM hosts h)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best
""",
}
