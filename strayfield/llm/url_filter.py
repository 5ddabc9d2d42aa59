"""URL filters: host-suffix and path-prefix expressions against a rule list.

Each URL is expanded into every host suffix (cut at the dots) combined with every path prefix whose
length some rule has. The expressions are equi-joined with the rules on the first eight hex digits of
their SHA-256; full digests confirm a hit; then the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SALTS = 16


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """One row (page_id, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has columns rule (host, then path from its slash on) and verdict (allow or block). The longest
    fitting rule wins; of equally long ones that with the longer host, then block. A null url, or one
    without ``://``, has an empty host and path and gets the default verdict, as does any url
    that no rule fits. Repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored. Rules are broadcast up to ``broadcast_rules`` rows; beyond, both sides are
    salted and shuffled.
    """
    digest, cut = F.sha2(F.col("_expr"), 256), F.instr("rule", "/")
    r = (
        rules.select("rule", "verdict").where("rule is not null and rule <> ''").dropDuplicates(["rule", "verdict"])
        .withColumn("_hostlen", F.when(cut > 0, cut - 1).otherwise(F.length("rule")))
        .withColumn("_pathlen", F.length("rule") - F.col("_hostlen"))
    )
    sizes = r.agg(
        F.count("*"), F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))
    ).first()
    lengths = sorted(x[0] for x in r.select("_pathlen").distinct().collect())  # at most as many as a rule path has characters
    r = r.withColumn("_expr", F.col("rule")).select(
        F.left(digest, F.lit(8)).alias("_short"), digest.alias("_digest"),
        (F.shiftleft(F.length("rule").cast("long"), 24) + F.shiftleft(F.col("_hostlen").cast("long"), 1) + (F.col("verdict") == "block").cast("long")).alias("_rank"),
    )

    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL, i), F.lit(""))
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    first = F.greatest(F.lit(1), n - (sizes[1] or 1) + 1)
    p = (
        pages.select(F.col(key).alias("page_id"), lower_ascii(part(1)).alias("host"), part(2).alias("path"), F.monotonically_increasing_id().alias("_row"))
        .withColumn("_suffixes", F.when(F.col("host") != "", F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>")))
        .withColumn("_prefixes", F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("path")))
        .withColumn("_exprs", F.flatten(F.transform("_suffixes", lambda s: F.transform("_prefixes", lambda x: F.concat(s, F.substring(F.col("path"), F.lit(1), x))))))
    )
    e = p.select("page_id", "host", "path", "_row", F.explode(F.concat(F.array(F.lit(None).cast("string")), "_exprs")).alias("_expr")).select("page_id", "host", "path", "_row", F.left(digest, F.lit(8)).alias("_short"), digest.alias("_full"))
    if sizes[0] <= broadcast_rules:
        hits = e.join(F.broadcast(r), "_short", "left")
    else:
        salted = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = e.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")).join(salted, ["_short", "_salt"], "left")
    best = (
        hits.withColumn("_rank", F.when(F.col("_full") == F.col("_digest"), F.col("_rank")))
        .where("_rank is not null or _full is null")
        .groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_rank").alias("_rank"))
    )
    host_len = F.shiftrightunsigned(F.col("_rank"), 1).bitwiseAND((1 << 23) - 1).cast("int")
    rule_len = F.shiftrightunsigned(F.col("_rank"), 24).cast("int")
    return best.select(
        "page_id", "host", "path",
        F.when(F.col("_rank").isNotNull(), F.concat(F.right("host", host_len), F.left("path", rule_len - host_len))).alias("rule"),
        F.when(F.col("_rank").isNull(), F.lit(default)).when(F.col("_rank").bitwiseAND(1) == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
