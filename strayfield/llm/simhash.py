"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked if at most ``most`` bits differ. The bits are dealt into m parts with a threshold t each, whose sum is most - m + 1 (a part
of threshold -1 isn't asked). If two fingerprints differ in more than t bits of every part, they differ in more than ``most`` in all; so
each link shows in some part. How the bits are grouped, how many parts there are, and which thresholds they get follows from the counts of all
fingerprints: bits that go together share a part, and dynamic programming spreads the thresholds so that the keys to write and the candidates to expect
cost the least.

A part of threshold t is probed by the keys that leave t of its bits out. Members of a key's bucket are compared in blocks, so a bucket of
any size is shared among tasks, and of the links found in two blocks only those that join something are told. Equal fingerprints are one node.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted
from .neardup import components

U = np.uint64
BITS = 64
SEED = 42


def fingerprint(text: bytes | None, size: int, step: int = 65_536) -> int:
    """Bit by bit the majority of the hashes of the ``size``-word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(size, len(words))
    n, ones = len(words) - size + 1, np.zeros(BITS, np.int64)
    for k in range(0, n, step):
        own = words[k : k + step + size - 1]
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(own[j:] for j in range(size)), strict=False)), repeat(SEED)), U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fingerprint(t, size) for t in part.column("text").to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(sign, f"doc_id {kind}, fp bigint")


def cooccurrence(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many of them have each two bits set. One small matrix comes from each task."""

    def count(batches):
        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 65_536):
                x = batch.column("fp").slice(k, 65_536).to_numpy(zero_copy_only=False)
                bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)  # exact up to 2^24
                both += bits.T @ bits
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.astype(np.int64).ravel()], pa.list_(pa.int64()))], names=["n", "both"])

    told = nodes.select("fp").mapInArrow(count, "n bigint, both array<bigint>")
    cells = told.select("n", F.posexplode("both").alias("at", "both")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for r in cells:
        both[r["at"]] = r["both"]
    return max((r["n"] for r in cells), default=0), both.reshape(BITS, BITS)


class Differ:
    """How often two random fingerprints differ in bits, from the counts of single bits and of pairs of bits."""

    def __init__(self, n: int, both: np.ndarray):
        p = np.diag(both) / max(n, 1)
        x11 = both / max(n, 1)
        x10, x01 = p[:, None] - x11, p[None, :] - x11
        x00 = 1 - x11 - x10 - x01
        cells = (x11, x10, x01, x00)
        #: that both bits of a pair agree, that only the first does, and that one bit does
        self.agree = sum(x * x for x in cells)
        self.first = 2 * (x11 * x10 + x01 * x00)
        self.one = p * p + (1 - p) ** 2
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        self.correlation = np.abs(x11 - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(self.correlation, 0)

    def within(self, bits: list[int], most: int) -> np.ndarray:
        """P(at most t of ``bits`` differ), t from 0 to ``most``: a chain in which a bit depends on the one before."""
        state = np.zeros((most + 2, 2))  # differing so far (the last row: too many) x the last bit differs
        state[0, 0], state[1, 1] = self.one[bits[0]], 1 - self.one[bits[0]]
        for a, b in zip(bits, bits[1:], strict=False):
            same = np.clip([self.agree[a, b] / max(self.one[a], 1e-12), (self.one[b] - self.agree[a, b]) / max(1 - self.one[a], 1e-12)], 0, 1)
            new = np.zeros_like(state)
            new[:, 0] = state @ same
            new[1:, 1] = (state @ (1 - same))[:-1]
            new[-1, 1] += (state @ (1 - same))[-1]
            state = new
        return np.minimum(1, np.cumsum(state.sum(1))[: most + 1])


def grouped(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` parts of about one size: each part is begun by the bit that goes most with those left, and takes the bit that goes most with its own."""
    left, found = list(range(len(correlation))), []
    for k in range(parts):
        own = [max(left, key=lambda b: (correlation[b, left].sum(), -b))]
        left.remove(own[0])
        for _ in range(-(-(len(left) + 1) // (parts - k)) - 1):
            own.append(max(left, key=lambda b: (correlation[own, b].max(), -b)))
            left.remove(own[-1])
        found.append(own)
    return found


def allotted(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds of this sum. ``costs`` has a list for each part, of threshold -1, 0, 1 and so on."""
    best = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t, c in enumerate(own, -1):
                if spent + t not in new or cost + c < new[spent + t][0]:
                    new[spent + t] = (cost + c, [*ts, t])
        best = new
    return best[total]


def planned(n: int, both: np.ndarray, most: int, key_cost: float = 100.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part asked. A key that is written, sorted and read costs as much as ``key_cost`` comparisons."""
    differ, best = Differ(n, both), None
    for parts in range(1, most + 2):
        groups = grouped(differ.correlation, parts)
        costs = []
        for bits in groups:
            off = np.diff(differ.within(bits, most), prepend=0)  # a pair that differs in d of the bits meets under every key that leaves these out
            meets = [n * n / 2 * sum(off[d] * comb(len(bits) - d, t - d) for d in range(t + 1)) for t in range(most + 1)]
            costs.append([0.0] + [m + key_cost * n * comb(len(bits), t) for t, m in enumerate(meets)])
        cost, ts = allotted(costs, most - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits that each key keeps, as 64-bit integers."""
    kept = [sum(1 << b for b in bits if b not in out) for bits, t in plan for out in map(set, combinations(bits, t))]
    return [x - (1 << 64) if x >> 63 else x for x in kept]


def joining(members: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links between ``members`` at the places ``left`` and those at ``right``, but only such that join what no link before them has joined."""
    found, of = [], np.arange(len(members))
    for k in range(0, len(left), 512):
        x = left[k : k + 512]
        near = np.bitwise_count(members[x][:, None] ^ members[right]) <= most
        for row in np.flatnonzero(near.any(1)):
            own, at = x[row], right[near[row]]
            apart, first = np.unique(of[at], return_index=True)
            others = apart != of[own]
            if others.any():
                found += [(own, q) for q in at[first[others]]]
                of[np.isin(of, apart[others])] = of[own]
    return found


def links(nodes: DataFrame, most: int = 3, block: int = 2048) -> DataFrame:
    """(a, b): enough links between distinct fingerprints ``fp`` that whatever can be reached by links can be reached by these."""
    n, both = cooccurrence(nodes)
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    kept = F.array(*[F.lit(x).cast("bigint") for x in masks(planned(n, both, most))])
    keys = nodes.select("fp", F.explode(kept).alias("kept")).select("fp", "kept", F.col("fp").bitwiseAND(F.col("kept")).alias("value"))
    sizes = keys.groupBy("kept", "value").agg(F.count("*").alias("_c")).where("_c > 1")
    met = persisted(keys.join(sizes, ["kept", "value"]), "simhash-buckets")
    blocks = F.ceil(F.col("_c") / block).cast("int")
    dealt = met.withColumn("_own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("kept", "value", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "fp")
    keys_of = ["kept", "value", "_i", "_j"]

    def meet(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            cols = [rows.column(c).to_numpy() for c in keys_of]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            begins = np.concatenate([[0], ends])
            yield from compared(rows, zip(begins[:-1], ends, strict=True))
            held = rows.slice(begins[-1])
        if held is not None:
            yield from compared(held, [(0, held.num_rows)])

    def compared(rows, cuts):
        fp, own, i, j = (rows.column(c).to_numpy() for c in ("fp", "_own", "_i", "_j"))
        a, b = [], []
        for low, high in cuts:
            if high - low > 1:
                members, side = fp[low:high], own[low:high]
                found = joining(members.view(U), np.flatnonzero(side == i[low]), np.flatnonzero(side == j[low]), most)
                a += [members[x] for x, _ in found]
                b += [members[y] for _, y in found]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition(*keys_of).sortWithinPartitions(*keys_of).mapInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text); component_id is the smallest doc_id that links reach.

    Null, empty and wordless texts have fingerprint zero, and are linked by it like any other. Rows that repeat a doc_id are one document with several
    fingerprints, and have one component_id. Rows without a doc_id link nothing, and their component_id is null. An empty table gives an empty result;
    other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = persisted(fingerprints(docs, size), "simhash-fingerprints")
    known = found.where("doc_id is not null")
    nodes = persisted(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "simhash-nodes")
    one = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_high")).where("a <> _high")
    several = known.join(one.select("doc_id", "a"), "doc_id").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    edges = persisted(links(nodes, most).union(several), "simhash-links")
    labels = components(edges)
    reached = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", "n", F.coalesce("component", "fp").alias("_root"))
    least = reached.groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    told = persisted(reached.join(least, "_root").select("fp", "n", "component_id"), "simhash-components")
    # fingerprints of more than a thousandth of all rows are fewer than a thousand: they are broadcast, the rest meets by fingerprint
    many = told.agg(F.sum("n")).first()[0] or 0
    hot = told.where(F.col("n") * 1000 > many).select("fp", F.col("component_id").alias("_hot"))
    rest = told.where(F.col("n") * 1000 <= many).select("fp", "component_id")
    out = found.join(F.broadcast(hot), "fp", "left")
    out = out.where("_hot is null").drop("_hot").join(rest, "fp", "left").unionByName(out.where("_hot is not null").withColumnRenamed("_hot", "component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).cast(kind)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))
