"""Mixing sources to target weights by packed blocks and pseudorandom index permutations.

The words of each source are packed, document after document, into blocks of a fixed number of words.
A source's target says how many block slots it fills; a multinomial draw spreads them over the
output shards. Slot j of a source is mapped through the source's permutation of epoch j // blocks to a
block index, and slots are joined with packed blocks by (source, index).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

WORD = r"[^ \t-\r]+"
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): four Feistel rounds, walked until inside the range."""
    half = U(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    x, out = index.astype(np.uint64), np.empty(len(index), np.int64)
    left = np.arange(len(index))
    while len(left):
        a, b = x >> half, x & mask
        for k in range(4):
            a, b = b, a ^ (mixed(b + U((key * 4 + k + 1) & 0xFFFFFFFFFFFF)) & mask)
        x = (a << half) | b
        inside = x < U(n)
        out[left[inside]] = x[inside].astype(np.int64)
        left, x = left[~inside], x[~inside]
    return out


def water_level(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    total, targets, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        by = left / sum(weights[i] for i in free)
        over = {i for i in free if by * weights[i] > most * sizes[i]}
        for i in over or free:
            targets[i] = float(most * sizes[i]) if over else by * weights[i]
        left -= sum(targets[i] for i in over)
        free = free - over if over else set()
    return targets


class Mix:
    """The mix of ``docs`` (doc_id, text, source).

    ``documents()`` has a row (doc_id, size, source_size, target, taken) per document row; ``slots()`` the output
    itself: a row (shard, slot, source, doc_id, first, words) per piece of a document in a slot, ``first`` being the
    word of the document it starts with. A null text has no words; a null source is a source of its own, last in
    order. Rows that repeat a doc_id count as documents of their own. An empty table, or one without words, gives
    targets of 0. Other columns are ignored. ``weights`` repeat over the sources in code point order.
    The result depends on the rows alone, not on their order, files or partitions. Slots are drawn in tasks of about ``task_slots``.
    At most ``max_sources`` sources are accepted: their names and sizes are the only thing that the driver sees.
    """

    def __init__(
        self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, block: int = 128, shard_slots: int = 4096, max_shards: int = 100_000, seed: int = 20,
        max_sources: int = 100_000, task_slots: int = 100_000,
    ):
        spark = docs.sparkSession
        self.block = block
        size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
        # _row tells rows apart; places in the order come from _place, which is the same however the table is cut
        sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("_place"), F.monotonically_increasing_id().alias("_row"))
        self.sized = persisted(sized, "mix-sizes")
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"over {max_sources} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] for r in found]
        targets = water_level(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], most)
        slots = [self.slot_plan(s, t) for s, t in zip(sizes, targets, strict=True)]
        shards = min(max_shards, max(1, math.ceil(sum(n for n, _ in slots) / shard_slots)))
        self.sources = spark.createDataFrame(
            [(i, r.source, s, t, n, cut) for i, (r, s, t, (n, cut)) in enumerate(zip(found, sizes, targets, slots, strict=True))],
            "_src int, source string, source_size long, target double, _slots long, _cut long",
        )
        self.shards, self.seed = shards, seed
        self.tasks = max(1, math.ceil(sum(n for n, _ in slots) / task_slots))
        self.buckets = max(256, math.ceil(sum(r.n for r in found) / 20_000))

    def slot_plan(self, size: int, target: float) -> tuple[int, int]:
        """(slots, words of the last one), so that a source's taken words are its rounded target."""
        words = round(target)
        if not words:
            return 0, 0
        epochs, rest = divmod(words, size)
        blocks, full = -(-size // self.block), size // self.block
        if not rest:
            return epochs * blocks, self.block
        last = min(-(-rest // self.block), full + 1)
        return epochs * blocks + last, rest - (last - 1) * self.block

    def pieces(self) -> DataFrame:
        """(_src, _block, doc_id, _row, at, words, skip): the piece of a document that lies in a block, at word ``at`` of it."""
        b, known = self.block, F.broadcast(self.sources.select("_src", F.col("source").alias("_name")))  # at most max_sources rows
        bucket = F.pmod("_place", F.lit(self.buckets)).cast("int").alias("_bucket")
        s = self.sized.where("size > 0").join(known, F.col("_name").eqNullSafe(F.col("source"))).select("_src", "doc_id", "_place", "_row", "size", bucket)
        before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = s.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum")).select("_src", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
        # rows alike in id and text are interchangeable: whichever comes first, the same numbers are dealt out among them
        inside = Window.partitionBy("_src", "_bucket").orderBy("_place", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_offset") + F.col("_before")
        p = s.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_src", "_bucket"]).select("_src", "doc_id", "_row", "size", start.alias("_start"))
        p = p.withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {b}"), F.expr(f"(_start + size - 1) div {b}"))))
        low, high = F.greatest("_start", F.col("_block") * b), F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * b)
        return p.select("_src", "_block", "doc_id", "_row", (low - F.col("_block") * b).alias("at"), (high - low).alias("words"), (low - F.col("_start")).alias("skip"))

    def drawn(self) -> DataFrame:
        """(_src, shard, slot, _block, _limit): the block of each slot, and how many of its words the slot takes."""
        shards, seed, block = self.shards, self.seed, self.block

        def counts(frames):
            for f in frames:
                for src, slots, cut, size in f.itertuples(index=False):
                    n = np.random.default_rng((seed, src)).multinomial(slots, np.full(shards, 1 / shards))
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"_src": np.int32(src), "shard": at, "first": (np.cumsum(n) - n)[at], "n": n[at], "size": size, "slots": slots, "cut": cut})

        def blocks(frames):
            for f in frames:
                for src, shard, first, n, size, slots, cut in f.itertuples(index=False):
                    full, every = size // block, -(-size // block)
                    for low in range(first, first + n, 1 << 18):
                        j = np.arange(low, min(low + (1 << 18), first + n))
                        epoch, place = j // every, j % every
                        index = np.full(len(j), full)
                        for e in np.unique(epoch):
                            own = (epoch == e) & (place < full)
                            if own.any():
                                index[own] = permuted(place[own], int(full), seed * 1_000_003 + src * 1009 + int(e))
                        limit = np.where(j == slots - 1, cut, block)
                        yield pd.DataFrame({"_src": np.int32(src), "shard": shard, "slot": j, "_block": index, "_limit": limit})

        per_shard = self.sources.where("_slots > 0").select("_src", "_slots", "_cut", "source_size").mapInPandas(counts, "_src int, shard long, first long, n long, size long, slots long, cut long")
        return per_shard.repartition(self.tasks, "_src", "shard").mapInPandas(blocks, "_src int, shard long, slot long, _block long, _limit long")

    def slots(self) -> DataFrame:
        """Slots and pieces both grow with the input and what pandas returns has no size that Spark knows: neither side is broadcast."""
        cut = F.least("words", F.col("_limit") - F.col("at"))
        return (
            self.drawn().hint("merge").join(self.pieces(), ["_src", "_block"]).where(cut > 0)
            .join(F.broadcast(self.sources.select("_src", "source")), "_src")
            .select("shard", "slot", "source", "doc_id", F.col("skip").alias("first"), cut.alias("words"), "_row")
        )

    def documents(self) -> DataFrame:
        taken = self.slots().groupBy("_row").agg(F.sum("words").alias("taken"))
        known = F.broadcast(self.sources.select(F.col("source").alias("_name"), "source_size", "target"))
        return (
            self.sized.join(known, F.col("_name").eqNullSafe(F.col("source")), "left").join(taken, "_row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")
        )

