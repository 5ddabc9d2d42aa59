"""Queries over vectors, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, vectors
from ..sources import feeds
from .registry import query

SIM = "list_dot_product(CAST(g.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(g.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
HITS = f"SELECT q.vec_id AS query_id, g.vec_id, g.canonical_id, g.individual_id, greatest(0.0, {SIM}) AS similarity FROM v_gallery g JOIN v_gallery q ON g.species = q.species WHERE q.vec_id % 10 = 0"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM ({HITS})"


def queries_of(t):
    """The stated query set: every tenth vector."""
    return t.v_gallery.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "species", "embedding", "individual_id")


def hits(t, k):
    names = t.v_gallery.select("vec_id", "canonical_id", "individual_id")
    return vectors.knn(t.v_gallery, queries_of(t), k).join(names, "vec_id")


@query(f"SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(similarity, 5) AS similarity FROM ({RANKED}) WHERE rank <= 10")
def knn_topk(t):
    return hits(t, 10).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH b AS (SELECT query_id, canonical_id, max(similarity) AS s FROM ({HITS}) WHERE canonical_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, canonical_id) AS rank FROM b) SELECT query_id, canonical_id, CAST(rank AS INT) AS rank, round(s, 5) AS similarity FROM r WHERE rank <= 10""")
def knn_per_animal(t):
    """The ten best animals by their best photo, whatever number of photos each has and however many tie."""
    return vectors.knn_animals(t.v_gallery, queries_of(t), 10).select("query_id", "canonical_id", "rank", F.round("similarity", 5).alias("similarity"))


@query()
def knn_approximate(t):
    return vectors.approximate_knn(t.v_gallery, queries_of(t), 10).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query("SELECT vec_id, round(list_sum([x * x for x in CAST(embedding AS DOUBLE[])]), 4) AS squared, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS first FROM embeddings")
def l2_normalize(t):
    v = vectors.l2_normalise(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), F.round(F.get(v, 0), 5).alias("first"))


@query(f"""WITH r AS ({RANKED}) SELECT query_id, bool_or(rank = 1 AND vec_id = query_id) AS is_self, round(max(similarity), 5) AS similarity, coalesce(round(max(similarity) FILTER (rank = 2), 9) < round(max(similarity), 9), TRUE) AS others_lower
FROM r WHERE rank <= 2 GROUP BY query_id""")
def self_match(t):
    """Each query finds itself first, and all others are less alike."""
    top = vectors.knn(t.v_gallery, queries_of(t), 2)
    second = F.max(F.when(F.col("rank") == 2, F.col("similarity")))
    return top.groupBy("query_id").agg(
        F.bool_or((F.col("rank") == 1) & (F.col("vec_id") == F.col("query_id"))).alias("is_self"), F.round(F.max("similarity"), 5).alias("similarity"),
        F.coalesce(F.round(second, 9) < F.round(F.max("similarity"), 9), F.lit(True)).alias("others_lower"),
    )


SPLIT = "SELECT *, CASE WHEN row_number() OVER (PARTITION BY individual_id ORDER BY vec_id) = 1 THEN 'gallery' ELSE 'query' END AS role FROM v_gallery"


@query(f"SELECT vec_id, individual_id, role FROM ({SPLIT})")
def gallery_split(t):
    return vectors.gallery_split(t.v_gallery, "individual_id", "vec_id").select("vec_id", "individual_id", "role")


EVAL = f"""WITH s AS ({SPLIT}), h AS (SELECT q.vec_id AS query_id, q.individual_id AS want, g.individual_id AS got, q.species, greatest(0.0, {SIM}) AS sim, g.vec_id FROM (SELECT * FROM s WHERE role = 'gallery') g JOIN (SELECT * FROM s WHERE role = 'query') q ON g.species = q.species),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM h), m AS (SELECT query_id, any_value(species) AS species, any_value(want) AS want, min(rank) FILTER (want = got AND rank <= 20) AS true_rank FROM r GROUP BY query_id)"""


def metrics(t):
    s = vectors.gallery_split(t.v_gallery, "individual_id", "vec_id")
    q = s.where("role = 'query'").select(F.col("vec_id").alias("query_id"), "species", "embedding", "individual_id")
    g = s.where("role = 'gallery'")
    h = vectors.knn(g, q, 20).join(g.select("vec_id", "individual_id"), "vec_id")
    return vectors.rank_metrics(h, q.select("query_id", "individual_id", "species"))


@query(EVAL + " SELECT count(*) AS queries, round(avg(CAST(coalesce(true_rank <= 1, FALSE) AS INT)), 6) AS rank1, round(avg(CAST(coalesce(true_rank <= 5, FALSE) AS INT)), 6) AS rank5, round(avg(CAST(coalesce(true_rank <= 20, FALSE) AS INT)), 6) AS rank20, round(avg(coalesce(1.0::DOUBLE / true_rank, 0)), 6) AS map FROM m")
def eval_rank_metrics(t):
    at = lambda k: F.round(F.avg(F.coalesce(F.col("true_rank") <= k, F.lit(False)).cast("int")), 6).alias(f"rank{k}")
    return metrics(t).agg(F.count("*").alias("queries"), at(1), at(5), at(20), F.round(F.avg("average_precision"), 6).alias("map"))


@query(EVAL + """, b AS (SELECT *, CASE query_id % 4 WHEN 0 THEN '30-60d' WHEN 1 THEN '61-120d' WHEN 2 THEN '121-365d' ELSE '1-2y' END AS gap FROM m)
SELECT species, gap, count(*) AS n, round(avg(CAST(coalesce(true_rank = 1, FALSE) AS INT)), 6) AS rank1, count(DISTINCT want) FILTER (true_rank = 1) AS found FROM b GROUP BY GROUPING SETS ((species), (gap))""")
def eval_slices(t):
    """Accuracy by species and by gap, in one pass over grouping sets."""
    gap = evaluation.gap_label(F.element_at(F.array(*[F.lit(x) for x in (30, 120, 121, 730)]), (F.col("query_id") % 4 + 1).cast("int")))
    hit = F.coalesce(F.col("true_rank") == 1, F.lit(False))
    d = metrics(t).withColumn("gap", gap)
    g = d.groupingSets([["species"], ["gap"]], "species", "gap")
    return g.agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("rank1"), F.countDistinct(F.when(hit, F.col("individual_id"))).alias("found"))


@query("SELECT individual_id FROM v_gallery WHERE vec_id % 2 = 0 INTERSECT SELECT individual_id FROM v_gallery WHERE vec_id % 2 = 1")
def split_overlap(t):
    """Individuals on both sides of a split: a leak."""
    g = t.v_gallery
    return g.where("vec_id % 2 = 0").select("individual_id").intersect(g.where("vec_id % 2 = 1").select("individual_id"))


@query("""WITH n AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 63 ELSE 64 END AS d FROM embeddings WHERE vec_id % 4 <> 1) SELECT vec_id, CAST(64 AS INT) AS dimension, vec_id % 2 = 0 AS was_there FROM embeddings
WHERE vec_id % 2 = 0 OR vec_id IN (SELECT vec_id FROM n WHERE d = 64)""")
def gallery_append(t):
    """A gallery of every other vector, to which three in four are appended: some known already, some of a wrong length."""
    e = t.embeddings.select("vec_id", "embedding")
    gallery = e.where("vec_id % 2 = 0")
    new = e.where("vec_id % 4 <> 1").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return vectors.appended(gallery, new, 64).select("vec_id", F.size("embedding").alias("dimension"), (F.col("vec_id") % 2 == 0).alias("was_there"))


@query("""WITH p AS (SELECT g / 10.0::DOUBLE AS strong, avg(CAST(is_match AS INT)) AS precision FROM v_pairs, range(2, 10) AS x(g) WHERE score >= g / 10.0::DOUBLE GROUP BY g),
b AS (SELECT strong FROM p WHERE precision > 0 ORDER BY round(precision, 12) DESC, strong LIMIT 1)
SELECT CASE WHEN count(*) > 0 THEN 0.1::DOUBLE ELSE 0.35 END AS possible, coalesce(max(strong), 0.65) AS strong FROM b""")
def fit_thresholds(t):
    return evaluation.fit_thresholds(t.v_pairs)


@query("""SELECT round(coalesce(avg(CAST(is_match AS INT)) FILTER (score >= 0.65), 0), 9) AS strong_precision, round(coalesce(avg(CAST(is_match AS INT)) FILTER (score >= 0.35 AND score < 0.65), 0), 9) AS possible_precision, count(*) AS n FROM v_pairs""")
def calibration_report(t):
    return evaluation.calibration_report(t.v_pairs).withColumns({c: F.round(c, 9) for c in ("strong_precision", "possible_precision")})


SESS = """l AS (SELECT *, lag(created) OVER (PARTITION BY animal ORDER BY created, picture) AS prev FROM v_pictures),
ss AS (SELECT *, CAST(sum(CASE WHEN floor((epoch_us(created) - epoch_us(prev)) / 86400000000) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY animal ORDER BY created, picture) AS BIGINT) AS session FROM l)"""
XS = SESS + """, a AS (SELECT animal, session, min(created) AS f, max(created) AS l, list(picture ORDER BY created, picture)[1:3] AS pics FROM ss GROUP BY ALL),
nw AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY animal ORDER BY session DESC) = 1),
pr AS (SELECT nw.animal, nw.session, a.session AS earlier, CAST(floor((epoch_us(nw.f) - epoch_us(a.l)) / 86400000000) AS BIGINT) AS gap_days, a.pics AS gallery, nw.pics AS queries FROM nw JOIN a ON a.animal = nw.animal AND a.session < nw.session),
xs AS (SELECT * FROM pr WHERE gap_days BETWEEN 30 AND 730 QUALIFY row_number() OVER (PARTITION BY animal ORDER BY earlier DESC) = 1)"""


def sessions(t):
    """Pictures with their organisation, which is read from their address."""
    url = F.concat_ws("/", F.lit("https://cdn.rescuegroups.org"), F.col("org").cast("string"), F.lit("pictures/animals"), F.col("picture").cast("string"))
    return evaluation.photo_sessions(t.v_pictures.withColumn("org", evaluation.organisation(url)))


@query(f"WITH {SESS} SELECT animal, picture, session FROM ss")
def photo_sessions(t):
    return sessions(t).select("animal", "picture", "session")


@query(f"WITH {XS} SELECT animal, session, earlier, gap_days, array_to_string(gallery, ',') AS gallery, array_to_string(queries, ',') AS queries FROM xs")
def xsession_pairs(t):
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return evaluation.session_pairs(sessions(t)).select("animal", "session", "earlier", F.col("gap_days").cast("bigint").alias("gap_days"), listed("gallery"), listed("queries"))


@query(f"WITH {XS} SELECT animal, 0 AS pos, 'gallery' AS role, gallery[1] AS picture FROM xs UNION ALL SELECT animal, CAST(i AS INT), 'query', queries[i] FROM xs, unnest(range(1, len(queries) + 1)) AS u(i)")
def eval_labels(t):
    return evaluation.eval_labels(evaluation.session_pairs(sessions(t)))


@query(f"""WITH {XS}, c AS (SELECT animal, max(session) AS s FROM ss GROUP BY animal), g AS (SELECT list_sort(list(gap_days)) AS g, count(*) AS n FROM xs)
SELECT (SELECT count(*) FROM c) AS animals, (SELECT count(DISTINCT animal) FROM ss WHERE picture IS NOT NULL) AS with_pictures, (SELECT count(*) FROM c WHERE s > 0) AS multi_session, (SELECT count(DISTINCT org) FROM ss) AS orgs, n AS eligible, g[CAST(floor(n / 4) AS INT) + 1] AS p25, g[CAST(floor(n / 2) AS INT) + 1] AS median, g[CAST(floor(3 * n / 4) AS INT) + 1] AS p75 FROM g""")
def manifest_stats(t):
    s = sessions(t)
    d = evaluation.manifest_statistics(evaluation.session_pairs(s), s)
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("p25", "median", "p75")})


@query("""WITH a AS (SELECT DISTINCT animal, species, org FROM v_pictures), o AS (SELECT species, org, least(5, count(*)) AS n FROM a GROUP BY ALL)
SELECT species, CAST(least(300, sum(n)) AS BIGINT) AS n FROM o GROUP BY species""")
def stratified_sample(t):
    """How many of each species the seeded sample takes."""
    return evaluation.stratified_sample(t.v_pictures.select("animal", "species", "org").distinct()).groupBy("species").agg(F.count("*").alias("n"))


@query("""SELECT animal AS individual_id, picture, CASE WHEN picture % 5 = 4 THEN NULL ELSE species END AS species FROM v_pictures WHERE picture % 5 < 3""")
def eval_samples(t):
    """Samples from paths <species>/<individual>/<image>: only image files count, and a path without a folder has no species."""
    ext = F.when(F.col("picture") % 5 < 3, F.element_at(F.array(F.lit("jpg"), F.lit("PNG"), F.lit("webp")), (F.col("picture") % 5 + 1).cast("int"))).otherwise("txt")
    paths = t.v_pictures.select(F.concat_ws("/", F.lit("/data"), "species", F.col("animal").cast("string"), F.concat(F.col("picture").cast("string"), F.lit("."), ext)).alias("path"))
    d = feeds.eval_samples(paths)
    return d.select(F.col("individual_id").cast("bigint").alias("individual_id"), F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1).cast("bigint").alias("picture"), "species")
