"""Document fingerprints by a homomorphic multiset hash.

A text is cut into pieces: paragraphs (lines), cut on at sentence ends and after 80 characters. Each piece
is hashed to a wide vector, and a text's fingerprint is the sum of its pieces' vectors modulo powers of two. So the
order of pieces doesn't matter, and pieces can be added to or taken from a fingerprint. Of the vector, some lanes are
40-bit hashes, which tell different multisets apart; the others add one hash bit per piece, three lanes of
20 bits to a number, and the angle between two such sums estimates how many pieces two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

#: A full stop ends a piece only before white space or at the end of the text: numbers, abbreviations and host names stay whole.
PIECE = r"(?:[^\n.]|\.(?=\S)){1,80}+\.?\n?|\.\n?|\n"
PAIR = (1 << 20) | 1
LOW20, LOW40 = (1 << 20) - 1, (1 << 40) - 1
BIT_WORDS = 40


def piece_sums() -> list[Column]:
    """Sums over the pieces in a group, of whose hashes _h0 to _h3 are null if there is no piece. None can overflow: 40-bit hashes are summed in halves,
    and a sum of bits holds two lanes of 20 bits, of which a text's two billion characters fill the upper to 52."""
    h = [F.col(f"_h{k}") for k in range(4)]
    wide = [x for k in (2, 3) for x in (h[k].bitwiseAND(LOW40), F.shiftrightunsigned(h[k], 24))]
    halves = [y for x in wide for y in (x.bitwiseAND(LOW20), F.shiftrightunsigned(x, 20))]
    pairs = [F.shiftright(h[k], a).bitwiseAND(PAIR) for k in (0, 1) for a in range(20)]
    # the third lanes, at bit 40 of the hashes, two to a sum, so far apart that the lower can't carry into the upper
    thirds = [F.shiftright(h[k], 40 + a).bitwiseAND(1) + F.shiftleft(F.shiftright(h[k], 41 + a).bitwiseAND(1), 32) for k in (0, 1) for a in range(0, 20, 2)]
    return [F.coalesce(F.sum(x), F.lit(0)) for x in halves + pairs + thirds]


def packed(s: list[Column]) -> list[Column]:
    """The vector of such sums: 4 hash lanes modulo 2^40, then 40 numbers of three bit lanes, the lower two modulo 2^40, the upper modulo 2^20."""
    wide = [(s[2 * k] + F.shiftleft(s[2 * k + 1].bitwiseAND(LOW20), 20)).bitwiseAND(LOW40) for k in range(4)]
    lanes = []
    for k in range(BIT_WORDS):
        third = s[8 + BIT_WORDS + k // 2]
        third = F.shiftrightunsigned(third, 32) if k % 2 else third
        lanes.append(s[8 + k].bitwiseAND(LOW40).bitwiseOR(F.shiftleft(third.bitwiseAND(LOW20), 40)))
    return wide + lanes


def joined(n: Column, v: Column, m: Column, w: Column, sign: int = 1) -> tuple[Column, Column]:
    """(n_pieces, vec) of two fingerprints' pieces together, or with ``sign`` -1 of the first one's without the second one's."""

    def lane(x, y, i):
        low = (x.bitwiseAND(LOW40) + sign * y.bitwiseAND(LOW40)).bitwiseAND(LOW40)
        high = (F.shiftrightunsigned(x, 40) + sign * F.shiftrightunsigned(y, 40)).bitwiseAND(LOW20)
        return F.when(i < 4, low).otherwise(low.bitwiseOR(F.shiftleft(high, 40)))

    pairs = F.zip_with(v, w, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return n + sign * m, F.transform(pairs, lambda p, i: lane(p["x"], p["y"], i))


def inserted(prints: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Fingerprints (key, n_pieces, vec) after the pieces of ``pieces`` (key, n_pieces, vec) were added; keys without any stay as they are."""
    return _changed(prints, pieces, key, 1)


def removed(prints: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Fingerprints after the pieces of ``pieces``, which must be among theirs, were taken away."""
    return _changed(prints, pieces, key, -1)


def _changed(prints: DataFrame, pieces: DataFrame, key: str, sign: int) -> DataFrame:
    d = prints.join(pieces.select(key, F.col("n_pieces").alias("_m"), F.col("vec").alias("_w")), key, "left")
    n, v = joined(F.col("n_pieces"), F.col("vec"), F.col("_m"), F.col("_w"), sign)
    own = F.col("_m").isNull()
    return d.select(*[c for c in prints.columns if c not in ("n_pieces", "vec")], F.when(own, F.col("n_pieces")).otherwise(n).alias("n_pieces"), F.when(own, F.col("vec")).otherwise(v).alias("vec"))


def dot(v: Column, n: Column, w: Column, m: Column) -> Column:
    """Inner product of the +1/-1 sums that two vectors' bit lanes stand for."""

    def three(x, y):
        at = lambda z, k, c: (F.shiftright(z, 20 * k).bitwiseAND(LOW20) * 2 - c).cast("double")
        return sum((at(x, k, n) * at(y, k, m) for k in (1, 2)), at(x, 0, n) * at(y, 0, m))

    return F.aggregate(F.zip_with(F.slice(v, 5, BIT_WORDS), F.slice(w, 5, BIT_WORDS), three), F.lit(0.0), lambda a, x: a + x)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per distinct ``keys``: n_pieces, and vec, the sum over the pieces of its texts. An empty text has no pieces."""
    cut = texts.select(*keys, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))).alias("_piece"))
    hashed = cut.select(*keys, "_piece", *[F.when(F.col("_piece").isNotNull(), F.xxhash64("_piece", F.lit(k))).alias(f"_h{k}") for k in range(4)])
    sums = [x.alias(f"_s{k}") for k, x in enumerate(piece_sums())]
    summed = hashed.groupBy(*keys).agg(F.count("_piece").alias("n_pieces"), *sums)
    return summed.select(*keys, "n_pieces", F.array(*packed([F.col(f"_s{k}") for k in range(len(sums))])).alias("vec"))


def shown(n: Column, vec: Column) -> Column:
    """The fingerprint as text."""
    return F.concat(F.lower(F.hex(n)), F.lit("-"), F.array_join(F.transform(vec, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def likeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """From 0 to 1; of equal fingerprints 1."""
    norm = F.sqrt(a["norm"] * b["norm"])
    angle = F.when(norm > 0, dot(a["vec"], a["n"], b["vec"], b["n"]) / norm).otherwise(0.0)
    return F.when((a["n"] == b["n"]) & (a["vec"] == b["vec"]), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), angle)))


def followers(docs: DataFrame) -> DataFrame:
    """(_id, _k2, n_chars, copies, _next_id, _next_k2): the successor of each document in the order of doc_id, after the last the first.

    Only ids, lengths and hashes are dealt out by range; the row behind each range's last is found among the ranges' first rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("_id", "_k2").agg(F.max("_chars").alias("n_chars"), F.count("*").alias("copies"))
    ids = persisted(ids.repartitionByRange(parts, "_id", "_k2").withColumn("_part", F.spark_partition_id()), "fingerprint-order")
    key = F.struct("_id", "_k2")
    inside = ids.withColumn("_next", F.lead(key).over(Window.partitionBy("_part").orderBy("_id", "_k2")))
    firsts = ids.groupBy("_part").agg(F.min(key).alias("_first"))  # one row per range
    behind = firsts.select("_part", F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(Window.partitionBy(F.lit(0)))).alias("_behind"))
    out = inside.join(F.broadcast(behind), "_part").withColumn("_next", F.coalesce("_next", "_behind"))
    return out.select("_id", "_k2", "n_chars", "copies", F.col("_next._id").alias("_next_id"), F.col("_next._k2").alias("_next_k2"))


def edited_fingerprints(docs: DataFrame, part: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last 1/``part`` is replaced by the head of the next document.

    One row (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``. A null
    text is empty; a null id comes first in order; rows that repeat an id are ordered by a hash of their texts, and rows that repeat
    id and text are one document, whose result is repeated. A document without a successor follows itself. An empty table gives an empty
    result; other columns are ignored. Two empty texts are alike (1), an empty and another are not (0).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a null id becomes the least value of its type's order by an extra flag in the key
    d = docs.select(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id")).alias("_id"), text.alias("text")).withColumns({"_k2": F.xxhash64("text"), "_chars": F.char_length("text")})
    order = persisted(followers(d), "fingerprint-next")
    body = d.select("_id", "_k2", "text")
    heads = order.select(F.col("_id").alias("_to_id"), F.col("_k2").alias("_to_k2"), "n_chars", "copies", F.col("_next_id").alias("_id"), F.col("_next_k2").alias("_k2"))
    one = body.dropDuplicates(["_id", "_k2"]) if order.where("copies > 1").limit(1).count() else body
    cut = F.expr(f"n_chars div {part}").cast("int")
    heads = heads.join(one, ["_id", "_k2"]).select(F.col("_to_id").alias("_id"), F.col("_to_k2").alias("_k2"), "n_chars", "copies", F.col("_id").alias("_next_id"), F.col("_k2").alias("_next_k2"), F.left("text", cut).alias("_head"))
    both = one.join(heads, ["_id", "_k2"]).withColumn("_edited", F.concat(F.left("text", F.col("n_chars") - cut), "_head"))
    keys = ["_id", "_k2", "n_chars", "copies", "_next_id", "_next_k2", "_sha", "_which"]
    texts = both.withColumn("_sha", F.sha2("_edited", 256)).select(*keys[:-1], F.posexplode(F.array("text", "_edited")).alias("_which", "_text"))
    prints = fingerprints(texts, keys, "_text")
    prints = persisted(prints.withColumn("norm", dot(F.col("vec"), F.col("n_pieces"), F.col("vec"), F.col("n_pieces"))), "fingerprints")
    side = lambda which, name, *more: prints.where(F.col("_which") == which).select("_id", "_k2", F.struct(F.col("n_pieces").alias("n"), "vec", "norm").alias(name), *more)
    a = side(0, "a", "n_chars", "copies", "_next_id", "_next_k2", "_sha").join(side(1, "e"), ["_id", "_k2"])
    c = side(0, "c").select(F.col("_id").alias("_next_id"), F.col("_k2").alias("_next_k2"), "c")
    parts = lambda name: {k: F.col(f"{name}.{k}") for k in ("n", "vec", "norm")}
    out = a.join(c, ["_next_id", "_next_k2"]).select(
        F.col("_id.id").cast(kind).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        shown(F.col("a.n"), F.col("a.vec")).alias("fingerprint"), shown(F.col("e.n"), F.col("e.vec")).alias("edited_fingerprint"),
        likeness(parts("a"), parts("e")).alias("near_edited"), likeness(parts("a"), parts("c")).alias("near_next"), "copies",
    )
    return out.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).drop("copies", "_copy")
