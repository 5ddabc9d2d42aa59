"""Benchmark decontamination by winnowed fingerprints.

Hashes of k consecutive words are taken at every word; of each sliding window of grams, which together
span ``window`` words, the smallest hash is kept as a fingerprint. Two texts that share a run of
``window`` words share a fingerprint inside it. Fingerprints of benchmark items are joined with those of the
documents; each hit is extended word by word to both sides and counts if the shared run is long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, persisted

#: Copies of the fingerprints where they are too many to broadcast.
SALTS = 16
#: A word, in a text whose A-Z aren't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def sliding(df: DataFrame, source: str, to: str, size: int, combine) -> DataFrame:
    """Add ``to``: combine() over ``size`` consecutive elements of ``source``, by doubling. Places closer than that to the end are meaningless."""
    step, have = 1, source
    while step < size:
        by = min(step, size - step)
        df = df.withColumn(f"_{to}{step + by}", F.zip_with(have, F.slice(have, by + 1, F.greatest(F.lit(0), F.size(have) - by)), combine))
        have, step = f"_{to}{step + by}", step + by
    return df.withColumn(to, F.col(have))


def fingerprinted(df: DataFrame, length: int, gram: int) -> DataFrame:
    """From ``_words``: ``_grams``, the hash at each word, and ``_lows``, the smallest hash of each window of ``length`` words."""
    gram = min(gram, length)
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))
    df = sliding(df, "_hash", "_g", gram, lambda a, b: F.xxhash64(a, b))
    df = sliding(df, "_g", "_m", length - gram + 1, lambda a, b: F.least(a, b))
    cut = lambda c, n: F.slice(c, 1, F.greatest(F.lit(0), F.size("_words") - (n - 1)))
    return df.withColumns({"_grams": cut("_g", gram), "_lows": cut("_m", length)})


def kept_grams(length: int, gram: int) -> Column:
    """The (length, place, hash) of the grams that are the smallest of a window that holds them, from _grams<length> and _lows<length>."""
    gram = min(gram, length)
    grams, lows = F.col(f"_grams{length}"), F.col(f"_lows{length}")
    at = F.transform(grams, lambda g, p: F.struct(F.lit(length).alias("_l"), p.alias("_p"), g.alias("_fp")))

    def smallest(x):
        around = [F.get(lows, x["_p"] - k) for k in range(length - gram + 1)]
        return (F.greatest(*around) if len(around) > 1 else around[0]) == x["_fp"]

    return F.filter(at, smallest)


def kept(length: int, gram: int) -> Column:
    """Whether the gram at word ``_p`` is the smallest of a window that holds it."""
    gram = min(gram, length)
    around = [F.get("_lows", F.col("_p") - k) for k in range(length - gram + 1)]
    return (F.greatest(*around) if len(around) > 1 else around[0]) == F.col("_fp")


def with_context(df: DataFrame, to: str, length: int, gram: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``to``: the words that windows around the gram at ``_p`` can have, lower-cased; null before the text.

    The words are sliced by a generator of one row: it stays inside generated code and so ends the whole word array's way there.
    """
    side = length - min(gram, length)
    start = F.greatest(F.lit(0), F.col("_p") - side)
    near = df.select(*keep, F.greatest(F.lit(0), F.lit(side) - F.col("_p")).alias("_pad"), F.explode(F.array(F.slice("_words", start + 1, F.greatest(F.lit(0), F.col("_p") + length - start)))).alias("_near"))
    words = F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("_pad")), F.transform("_near", lower_ascii))
    return near.select(*keep, words.alias(to))


def with_contexts(df: DataFrame, lengths: list[int], gram: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``_here``, as ``with_context``, for each row's own length ``_l``; of a text's own row (0) no words."""
    side = F.lit(0)
    for length in lengths:
        side = F.when(F.col("_l") == length, length - min(gram, length)).otherwise(side)
    start = F.greatest(F.lit(0), F.col("_p") - side)
    upto = F.when(F.col("_l") == 0, 0).otherwise(F.greatest(F.lit(0), F.col("_p") + F.col("_l") - start))
    near = df.select(*keep, F.greatest(F.lit(0), side - F.col("_p")).alias("_pad"), F.explode(F.array(F.slice("_words", start + 1, upto))).alias("_near"))
    words = F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("_pad")), F.transform("_near", lower_ascii))
    return near.select(*keep, words.alias("_here"))


def item_prints(items: DataFrame, length: int, gram: int, window: int) -> DataFrame:
    """(_fp, item_id, _there) of the items of ``length`` words, or of at least so many if that is ``window``."""
    n = F.size("_words")
    own = items.where(n >= length if length == window else n == length)
    prints = fingerprinted(own, length, gram).select("item_id", "_words", "_lows", F.posexplode("_grams").alias("_p", "_fp")).where(kept(length, gram))
    return with_context(prints, "_there", length, gram, ["_fp", "item_id"]).distinct()


def run_around(length: int, gram: int) -> tuple[Column, Column]:
    """First word and the word after the last of the shared run around ``_p``."""
    gram, side = min(gram, length), length - min(gram, length)
    same = F.zip_with("_here", "_there", lambda a, b: F.coalesce(a == b, F.lit(False)))
    whole = ~F.array_contains(F.slice(same, side + 1, gram), False)
    if not side:
        return F.when(whole, F.col("_p")), F.col("_p") + gram
    stop = lambda part: F.coalesce(F.nullif(F.array_position(part, False), F.lit(0)) - 1, F.size(part)).cast("int")
    left, right = stop(F.reverse(F.slice(same, 1, side))), stop(F.slice(same, length + 1, side))
    return F.when(whole & (left + right + gram >= length), F.col("_p") - left), F.col("_p") + gram + right


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 4, broadcast_prints: int = 50_000) -> DataFrame:
    """One row (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) per row of ``docs``.

    n_hit counts the words inside a run of at least ``window`` words that an item has too; an item with fewer words must
    occur whole. ``items`` lists their ids, ``spans`` the runs as (first word, word after the last), overlapping ones as found.
    A null or empty text has no words and no hits; a null or wordless item, or one without an id, never occurs; rows
    that repeat an item_id are one item; repeated document rows give repeated results; empty tables give no hits
    or no rows. Other columns are ignored. Item fingerprints are broadcast up to ``broadcast_prints`` rows; beyond
    that both sides are shuffled.
    """
    words = lambda: F.coalesce(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    items = benchmark.where("item_id is not null").select("item_id", words().alias("_words")).where(F.size("_words") > 0)
    short = sorted(r[0] for r in items.where(F.size("_words") < window).select(F.size("_words")).distinct().collect())  # fewer than ``window`` numbers
    base = docs.select("doc_id", F.xxhash64("text").alias("_k"), words().alias("_words")).select(F.monotonically_increasing_id().alias("_row"), "*")
    own = ["doc_id", "_row", "_k", "_n", "_p"]

    # a text's words are found once; the grams of each length that some item has are columns beside them
    lengths = [window, *short]
    d, places = base, F.array(F.struct(F.lit(0).alias("_l"), F.lit(-1).alias("_p"), F.lit(None).cast("bigint").alias("_fp")))
    for length in lengths:
        d = fingerprinted(d, length, gram).withColumnsRenamed({"_grams": f"_grams{length}", "_lows": f"_lows{length}"})
        places = F.concat(places, kept_grams(length, gram))
    # of each text its row (_l = 0), which stands apart from all joins, and its fingerprints
    d = d.select("doc_id", "_row", "_k", F.size("_words").alias("_n"), "_words", F.explode(places).alias("_at")).select("doc_id", "_row", "_k", "_n", "_words", "_at.*")

    prints = None
    for length in lengths:
        p = item_prints(items, length, gram, window).select(F.lit(length).alias("_l"), "_fp", "item_id", "_there")
        prints = p if prints is None else prints.unionByName(p)
    few = prints.limit(broadcast_prints + 1).count() <= broadcast_prints
    span = F.struct(F.col("_first").alias("first"), F.col("_end").alias("end"))

    def extended(j: DataFrame) -> DataFrame:
        first, end = F.lit(None).cast("int"), F.lit(None).cast("int")
        for length in lengths:
            f, e = run_around(length, gram)
            first, end = F.when(F.col("_l") == length, f).otherwise(first), F.when(F.col("_l") == length, e).otherwise(end)
        return j.withColumns({"_first": F.when(F.col("_l") > 0, first), "_end": end})

    if few:
        j = d.join(F.broadcast(prints), ["_l", "_fp"], "left").where((F.col("_p") == -1) | F.col("item_id").isNotNull())
        j = extended(with_contexts(j, lengths, gram, [*own, "_l", "item_id", "_there"])).where((F.col("_p") == -1) | F.col("_first").isNotNull())
        hits = j.select("doc_id", "_row", "_k", "_n", F.when(F.col("_p") >= 0, span).alias("_span"), F.when(F.col("_p") >= 0, F.col("item_id")).alias("_item"))
    else:
        # a print may stand in very many texts, or in very many items: its rows are dealt out by salt
        cut = persisted(with_contexts(d, lengths, gram, [*own, "_l", "_fp"]), "decontam-grams")
        salted = prints.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = cut.where("_p >= 0").withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["_l", "_fp", "_salt"])
        found = extended(j).where("_first is not null").select("doc_id", "_row", "_k", "_n", span.alias("_span"), F.col("item_id").alias("_item"))
        empty = found.schema
        alone = cut.where("_p = -1").select("doc_id", "_row", "_k", "_n", F.lit(None).cast(empty["_span"].dataType).alias("_span"), F.lit(None).cast(empty["_item"].dataType).alias("_item"))
        hits = alone.unionAll(found)
    per_doc = hits.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("_k").alias("text_hash"), F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_set("_span")).alias("spans"), F.array_sort(F.collect_set("_item")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["first"]))).cast("long").alias("n")), lambda a: a["n"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return per_doc.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans", "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without those that share a run of ``window`` words, or a whole shorter item, with the benchmark."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
