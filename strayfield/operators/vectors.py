"""Vector search over galleries, and the evaluation of retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import block_pairs, stored

#: Rows of a block of gallery and of queries.
PER_BLOCK = (65_536, 4096)
#: Similarities that are held at once.
HELD = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length in double; a vector of nearly no length becomes zeros."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm < 1e-9, 0.0).otherwise(x.cast("double") / F.greatest(norm, F.lit(1e-9))))


def in_blocks(gallery: DataFrame, queries: DataFrame, key: str, per_block: tuple[int, int], score, schema: str) -> DataFrame:
    """``score`` (an Arrow function of a gallery block and a query block) on every pair of blocks of about ``per_block`` rows."""
    return block_pairs(*(stored(d.where("embedding is not null"), "vectors") for d in (gallery, queries)), per_block, score, schema)


def kinds(gallery: DataFrame, queries: DataFrame, key: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {gallery.schema[key].dataType.simpleString()}"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of lists of one length."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(values.flatten(), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def by_species(g: pa.Table, q: pa.Table):
    """(gallery rows, query rows) of each species that both have."""
    a, b = (np.array(t["species"].to_pylist(), object) for t in (g, q))
    for s in sorted({*a} & {*b} - {None}):
        yield np.flatnonzero(a == s), np.flatnonzero(b == s)


def knn(gallery: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", per_block: tuple[int, int] = PER_BLOCK) -> DataFrame:
    """(query_id, key, similarity, rank): the k most alike of each query's species; similarity is max(0, cosine).

    Exact. Blocks of queries (query_id, species, embedding) meet blocks of the gallery; one matrix product gives a block's candidates, of which
    the k best of each query, with all that tie with the last, go on to the window over a query.
    """

    def score(g: pa.Table, q: pa.Table) -> pa.Table:
        a, b = matrix(g["embedding"]), matrix(q["embedding"])
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for own, asked in by_species(g, q):
            step = max(1, HELD // len(own))
            for low in range(0, len(asked), step):
                part = asked[low : low + step]
                sim = np.maximum(0.0, b[part] @ a[own].T)
                least = np.partition(sim, -k, axis=1)[:, -k, None] - 1e-9 if len(own) > k else -1.0
                x, y = np.nonzero(sim >= least)
                rows.append(part[x])
                cols.append(own[y])
                values.append(sim[x, y])
        return pa.table({"query_id": q["query_id"].take(pa.array(np.concatenate(rows))), key: g[key].take(pa.array(np.concatenate(cols))), "similarity": np.concatenate(values)})

    found = in_blocks(gallery.select(key, "species", "embedding"), queries.select("query_id", "species", "embedding"), key, per_block, score, f"{kinds(gallery, queries, key)}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_animal(hits: DataFrame, k: int) -> DataFrame:
    """From (query_id, canonical_id, similarity) the k best animals per query by their best photo."""
    best = hits.groupBy("query_id", "canonical_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "canonical_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_animals(gallery: DataFrame, queries: DataFrame, k: int, animal: str = "canonical_id", key: str = "vec_id", per_block: tuple[int, int] = PER_BLOCK) -> DataFrame:
    """(query_id, animal, similarity, rank): the k animals whose best photo is most alike to each query, of its species, whatever number of photos each has.

    Exact: a block gives its k best animals by their best photo in it, and the block with an animal's best photo of all has it among them
    unless k animals beat it. Photos without an animal are no hits.
    """

    def score(g: pa.Table, q: pa.Table) -> pa.Table:
        a, b = matrix(g["embedding"]), matrix(q["embedding"])
        _, animals = np.unique(np.array(g[animal].to_pylist(), object), return_inverse=True)
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for own, asked in by_species(g, q):
            own = own[np.argsort(animals[own], kind="stable")]
            starts = np.flatnonzero(np.diff(animals[own], prepend=-1))
            step = max(1, HELD // len(own))
            for low in range(0, len(asked), step):
                part = asked[low : low + step]
                sim = np.maximum.reduceat(np.maximum(0.0, b[part] @ a[own].T), starts, axis=1)
                least = np.partition(sim, -k, axis=1)[:, -k, None] - 1e-9 if len(starts) > k else -1.0
                x, y = np.nonzero(sim >= least)
                rows.append(part[x])
                cols.append(own[starts[y]])
                values.append(sim[x, y])
        return pa.table({"query_id": q["query_id"].take(pa.array(np.concatenate(rows))), animal: g[animal].take(pa.array(np.concatenate(cols))), "similarity": np.concatenate(values)})

    owned = gallery.where(F.col(animal).isNotNull()).select(key, animal, "species", "embedding")
    found = in_blocks(owned, queries.select("query_id", "species", "embedding"), key, per_block, score, f"{kinds(gallery, queries, animal)}, similarity double")
    return per_animal(found.withColumnRenamed(animal, "canonical_id"), k).withColumnRenamed("canonical_id", animal)


def signatures(d: DataFrame, bits: int, seed: int) -> DataFrame:
    """``d`` with ``code`` for ``embedding``: on which side of each of ``bits`` random hyperplanes a vector lies."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "embedding"]

    def sign(batches):
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("embedding"))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], bits))
            code = np.packbits(m @ planes > 0, axis=1)
            rest = [n for n in batch.schema.names if n != "embedding"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([x.tobytes() for x in code], pa.binary())], names=[*rest, "code"])

    rest = [c for c in d.columns if c != "embedding"]
    return d.where("embedding is not null").select(*rest, "embedding").mapInArrow(sign, ", ".join([*fields, "code binary"]))


def approximate_knn(gallery: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", bits: int = 1024, rescored: int = 5, seed: int = 3, per_block: tuple[int, int] = PER_BLOCK) -> DataFrame:
    """Neighbours by hyperplane signatures: as ``knn``, but approximate.

    Every gallery vector has a signature of ``bits`` bits. A query's ``rescored`` * k nearest signatures, by differing bits, are all whose vectors are
    read and compared in full. Recall is measured against ``knn`` in the tests.
    """
    few = rescored * k

    def score(g: pa.Table, q: pa.Table) -> pa.Table:
        words = lambda t: np.frombuffer(b"".join(t["embedding"].to_pylist()), np.uint64).reshape(t.num_rows, bits // 64)
        a, b = words(g), words(q)
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, asked in by_species(g, q):
            mine = a[own]
            for x in asked:
                differ = np.bitwise_count(mine ^ b[x]).sum(1, dtype=np.int64)
                top = np.argpartition(differ, few - 1)[:few] if len(own) > few else np.arange(len(own))
                rows.append(np.full(len(top), x))
                cols.append(own[top])
                values.append(differ[top])
        return pa.table({"query_id": q["query_id"].take(pa.array(np.concatenate(rows))), key: g[key].take(pa.array(np.concatenate(cols))), "differ": np.concatenate(values)})

    own, asked = gallery.select(key, "species", "embedding"), queries.select("query_id", "species", "embedding")
    code = lambda d: signatures(d, bits, seed).withColumnRenamed("code", "embedding")
    found = in_blocks(code(own), code(asked), key, per_block, score, f"{kinds(gallery, queries, key)}, differ bigint")
    near = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("differ", key))).where(F.col("_n") <= few)
    pairs = near.join(own.select(key, F.col("embedding").alias("_g")), key).join(asked.select("query_id", F.col("embedding").alias("_q")), "query_id")
    cosine = F.greatest(F.lit(0.0), dot(F.col("_g"), F.col("_q")) / F.greatest(F.sqrt(dot(F.col("_g"), F.col("_g"))) * F.sqrt(dot(F.col("_q"), F.col("_q"))), F.lit(1e-9)))
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), key)
    return pairs.select("query_id", key, cosine.alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def appended(gallery: DataFrame, vectors: DataFrame, d: int, key: str = "vec_id") -> DataFrame:
    """The gallery with the new vectors of the right length; a key that it has already keeps its first vector. A rebuild is the same on an empty gallery."""
    good, _ = checked_dimension(vectors, d)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("embedding")))
    new = good.withColumn("_n", first).where("_n = 1").drop("_n").join(gallery.select(key), key, "left_anti")
    return gallery.unionByName(new.select(gallery.columns))


def checked_dimension(vectors: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the right length, rows to reject)."""
    good = F.coalesce(F.size("embedding") == d, F.lit(False))
    return vectors.where(good), vectors.where(~good)


def gallery_split(samples: DataFrame, individual: str, order: str) -> DataFrame:
    """The first sample of each individual is gallery, the others are queries."""
    n = F.row_number().over(Window.partitionBy(individual).orderBy(order))
    return samples.withColumn("role", F.when(n == 1, "gallery").otherwise("query"))


def rank_metrics(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: the rank of the right individual among its hits (null if absent) and the reciprocal rank.

    ``hits`` has (query_id, individual_id, rank), ``queries`` (query_id, individual_id).
    """
    right = hits.select("query_id", F.col("individual_id").alias("_hit"), "rank").join(queries.select("query_id", "individual_id"), "query_id").where(F.col("_hit") == F.col("individual_id"))
    true = right.groupBy("query_id").agg(F.min("rank").alias("true_rank"))
    return queries.join(true, "query_id", "left").withColumn("average_precision", F.coalesce(1 / F.col("true_rank"), F.lit(0.0)))
