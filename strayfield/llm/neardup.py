"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys are made, each half key from a few minhashes. A table key is a pair of one half key of either
collection, so 10 + 10 half keys give 100 tables, and the minhashes needed grow with the square root of the tables. Documents that share
a table key are candidates. Candidates are confirmed on their full shingle sets; components of confirmed links are the groups.

Documents with equal sets are one node from the start. Every node is first compared with a few centres alone: each bucket's node that
meets the most others. Buckets in which the components found so far are still several then have all their pairs across
components compared, but for those whose minhashes agree too rarely. So a group of copies of one text costs a few comparisons per
member, and no link between buckets' members that could join two components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

U = np.uint64
SALTS = 32


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of fewer words than ``size``, one of them all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(WORDS.__getitem__, words), U, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    x = mixed(h[:n] + U(k))
    for j in range(1, k):
        x = mixed(x * U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(x)


def drawn(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.int64).astype(U)
    return (draw[0] << U(1)) | U(1), draw[1]


def lowest(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minhash of each function a x + b."""
    low = np.full(len(a), U(0xFFFFFFFFFFFFFFFF))
    step = max(1, 200_000 // len(a))
    for k in range(0, len(shingles), step):
        low = np.minimum(low, (shingles[None, k : k + step] * a[:, None] + b[:, None]).min(1))
    return low


class Tables:
    """``sides`` half keys in each of two collections, of ``rows`` minhashes each."""

    def __init__(self, sides: int, rows: int, seed: int = 4):
        self.sides, self.rows = sides, rows
        self.a, self.b = drawn(2 * sides * rows, seed)

    def half_keys(self, shingles: np.ndarray) -> np.ndarray:
        low = lowest(shingles, self.a, self.b).reshape(2 * self.sides, self.rows)
        x = mixed(low[:, 0])
        for j in range(1, self.rows):
            x = mixed(x * U(0x9E3779B97F4A7C15) + low[:, j])
        return x


def sketched(docs: DataFrame, size: int, tables: Tables) -> DataFrame:
    """(doc_id, text_hash, _row, n, _s1, _s2, _half) of each row: set size, 128-bit set hash, half keys. Without words n is 0 and the rest null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                n, s, half = [], [], []
                for t in part.column("text").to_pylist():
                    u = shingle_set(t, size)
                    n.append(len(u))
                    s.append(np.frombuffer(xxh3_128_digest(u.tobytes()), np.int64) if len(u) else (None, None))
                    half.append(tables.half_keys(u).view(np.int64) if len(u) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), part.column("_row"), pa.array(n, pa.int64()), pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int64()), pa.array(half, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "_row", "n", "_s1", "_s2", "_half"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {kind}, text_hash bigint, _row bigint, n bigint, _s1 bigint, _s2 bigint, _half array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, broadcast_ids: int = 500_000) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough. Only the texts of ids in a pair are moved."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    one, two = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"_{c}")) for c in "ab")

    def check(batches):
        last, own = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = []
                for s, t in zip(part.column("_a").to_pylist(), part.column("_b").to_pylist(), strict=True):
                    if s != last:
                        last, own = s, shingle_set(s, size)
                    other = shingle_set(t, size)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(one, "a").join(two, "b").mapInArrow(check, f"a {kind}, b {kind}")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, rounds: int = 100, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component) of every node with an edge (a, b): the smallest node reachable. Smallest labels spread, and labels' labels are taken, until nothing changes."""
    edges = persisted(edges.select("a", "b").union(edges.select("b", "a")), "neardup-edges")
    labels = persisted(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "neardup-labels")
    few = labels.count() <= broadcast_rows
    hint = F.broadcast if few else (lambda d: d)
    for _ in range(rounds):
        own = labels.select("node", "component", F.col("component").alias("_old"))
        near = edges.join(hint(labels.withColumnRenamed("node", "b")), "b").select(F.col("a").alias("node"), "component", F.lit(None).cast(labels.schema["node"].dataType).alias("_old"))
        spread = near.unionByName(own).groupBy("node").agg(F.min("component").alias("_new"), F.max("_old").alias("_old"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_far"))
        new = persisted(spread.join(hint(jump), "_new", "left").select("node", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") != F.col("_old")).alias("_changed")), "neardup-labels")
        labels = new.select("node", "component")
        if not new.where("_changed").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def signed(docs: DataFrame, ids: DataFrame, size: int, width: int = 1024) -> DataFrame:
    """(node, _bits): one bit of each of ``width`` more minhashes, of the documents in ``ids`` (node)."""
    a, b = drawn(width, 41)
    own = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).join(small(ids, 500_000), "node", "left_semi")

    def sign(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                low = [mixed(lowest(shingle_set(t, size), a, b)) & U(1) for t in part.column("text").to_pylist()]
                bits = [np.packbits(x.astype(np.uint8)).view(np.int64) for x in low]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(bits, pa.list_(pa.int64()))], names=["node", "_bits"])

    return own.mapInArrow(sign, f"node {docs.schema['doc_id'].dataType.simpleString()}, _bits array<bigint>")


def worth_confirming(side: DataFrame, width: int, sides: int, percent: int, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of different components that meet in a bucket and are worth confirming; ``side`` has a row (key, node, of, _c, n, _half, _bits) per member.

    Sizes must allow the pair, it hasn't met in an earlier table, and its bits agree as often as those of a pair at the limit, less four standard
    deviations (3 in 100,000 such pairs agree less often). A bucket's members are dealt into blocks of about ``block``, and each two blocks
    meet in one task, so a bucket of any size is shared among tasks, and a task holds two blocks of it at a time.
    """
    p = (1 + percent / 100) / 2
    most = int(width - (width * p - 4 * (width * p * (1 - p)) ** 0.5))
    blocks = F.ceil(F.col("_c") / block).cast("int")
    dealt = side.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "node", "of", "n", "_half", "_bits")
    kind = side.schema["node"].dataType.simpleString()

    def met(rows):
        """Indices of the pairs of one bucket's two blocks."""
        own, n = rows.column("_own").to_numpy(), rows.column("n").to_numpy()
        of = rows.column("of").dictionary_encode().indices.to_numpy()
        half = rows.column("_half").flatten().to_numpy().reshape(len(n), -1)
        bits = rows.column("_bits").flatten().to_numpy().reshape(len(n), -1)
        i, j = rows.column("_i")[0].as_py(), rows.column("_j")[0].as_py()
        row, col = divmod(rows.column("key")[0].as_py() & 127, sides)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for k in range(0, len(left), 128):
            x = left[k : k + 128]
            apart = of[x][:, None] != of[right]
            if i == j:
                apart &= x[:, None] < right
            a, b = np.nonzero(apart)
            a, b = x[a], right[b]
            fit = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
            a, b = a[fit], b[fit]
            fit = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most
            a, b = a[fit], b[fit]
            equal = half[a] == half[b]
            fit = ~(equal[:, :row].any(1) | equal[:, sides : sides + col].any(1))
            yield a[fit], b[fit]

    def meet(batches):
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "_i", "_j"))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins = np.concatenate([[0], ends])
            for k, end in zip(begins[:-1], ends, strict=True):
                yield from told(rows.slice(k, end - k))
            kept = rows.slice(begins[-1])
        if kept is not None:
            yield from told(kept)

    def told(rows):
        if len(rows) > 1:
            for a, b in met(rows):
                if len(a):
                    yield pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(c)) for c in (a, b)], names=["a", "b"])

    sorted_ = dealt.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    pairs = sorted_.mapInArrow(meet, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, sides: int = 10, rows: int = 3, stars: int = 3) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept, text_hash) per row of ``docs`` (doc_id, text).

    A document's set is its distinct ``size``-word shingles. Documents are linked if 100 * intersection >= ``percent`` * union;
    component_id is the smallest doc_id reachable. Null, empty and wordless texts have an empty set and stand alone, as do rows without a
    doc_id (their component_id is null, and they are kept). Rows that repeat a doc_id are one document with several sets, and have one component_id. An
    empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= sides <= 11:
        raise ValueError("sides must be from 1 to 11: a key has seven bits for the number of its table")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = persisted(sketched(docs, size, Tables(sides, rows)), "neardup-sketches")
    real = found.where("n > 0 and doc_id is not null")
    # equal sets: one node, the smallest id of them
    same = persisted(real.groupBy("_s1", "_s2").agg(F.min("doc_id").alias("_node"), F.count("*").alias("_c")).where("_c > 1").select("_s1", "_s2", "_node"), "neardup-same")
    salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")
    nodes = real.withColumn("_salt", salt).join(salted, ["_s1", "_s2", "_salt"], "left").where("_node is null or _node = doc_id").select(F.col("doc_id").alias("node"), "n", "_half")
    nodes = persisted(nodes, "neardup-nodes")
    # rows that repeat an id are one document: what stands for their sets is linked with it
    again = persisted(real.groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1").select("doc_id"), "neardup-again")
    several = real.withColumn("_salt", salt).join(small(again, 500_000), "doc_id", "left_semi").join(salted, ["_s1", "_s2", "_salt"]).where("_node <> doc_id")
    several = persisted(several.select(F.least("doc_id", "_node").alias("a"), F.greatest("doc_id", "_node").alias("b")).distinct(), "neardup-several")

    t, s = F.col("_t"), F.lit(sides)
    # the table's number is the key's last seven bits
    hashed = F.xxhash64(t, F.get("_half", F.floor(t / s).cast("int")), F.get("_half", s + t % s)).bitwiseAND(-128).bitwiseOR(t.cast("bigint"))
    keyed = nodes.select("node", "_half", F.explode(F.sequence(F.lit(0), F.lit(sides * sides - 1))).alias("_t")).select("node", hashed.alias("key"))
    sizes = persisted(keyed.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1"), "neardup-buckets")
    members = persisted(keyed.join(sizes, "key"), "neardup-members")

    # a node's weight: how many it meets in its buckets; the text that others were copied from meets the most
    weights = members.groupBy("node").agg(F.sum(F.col("_c") - 1).alias("_w"))
    weighed = persisted(members.join(weights, "node").select("key", "node", (F.shiftleft("_w", 16) + F.pmod(F.xxhash64("node"), F.lit(1 << 16))).alias("_w")), "neardup-weighed")
    leads = weighed.groupBy("key").agg(F.max_by("node", "_w").alias("lead"), F.max("_w").alias("_lw"))
    met = weighed.join(leads, "key").where("node <> lead").groupBy("node", "lead").agg(F.max("_lw").alias("_lw"))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.col("_lw").desc(), "lead"))).where(F.col("_n") <= stars)
    first = persisted(best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "neardup-pairs")
    links = persisted(confirmed(first, docs, size, percent), "neardup-links").union(several)
    labels = components(links)

    of = members.join(small(labels, 500_000), "node", "left").select("key", "node", F.coalesce("component", "node").alias("of"))
    split = persisted(of.groupBy("key").agg(F.min("of").alias("_low"), F.max("of").alias("_high"), F.count("*").alias("_c")).where("_low <> _high").select("key", "_c"), "neardup-split")
    open_ = persisted(of.join(small(split, 500_000), "key"), "neardup-open")
    bits = signed(docs, open_.select("node").distinct(), size)
    about = nodes.select("node", "n", F.transform("_half", lambda h: F.hash(h)).alias("_half")).join(bits, "node")
    about = persisted(about.dropDuplicates(["node", "n", "_half"]), "neardup-signed")
    rest = worth_confirming(open_.join(small(about, 100_000), "node"), 1024, sides, percent)
    rest = persisted(rest.join(first, ["a", "b"], "left_anti"), "neardup-pairs")
    more = persisted(confirmed(rest, docs, size, percent), "neardup-links")
    if more.limit(1).count():
        labels = components(links.union(more))

    groups = persisted(same.join(labels, same["_node"] == labels["node"], "left").select("_s1", "_s2", F.coalesce("component", "_node").alias("_group")), "neardup-groups")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = found.withColumn("_salt", salt).join(groups, ["_s1", "_s2", "_salt"], "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("_group", "component", "doc_id").cast(kind)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest id; of rows that repeat id and text one stays.

    Rows that repeat an id are one document, and go or stay together. Rows without an id, or without words, all stay.
    """
    found = persisted(near_duplicates(docs, size, percent).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept"), "neardup-kept")
    left = docs.join(found.where("not kept").select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_anti")
    again = persisted(found.where("kept and _id is not null").groupBy("_id", "_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_hash"), "neardup-again")
    if not again.limit(1).count():
        return left
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
