"""A Merkle manifest of a dataset by time-forward processing.

Each group's leaves, in order, are the first level of a tree of fan-out three, and the groups' roots, in order, the leaves of one more tree.
Nodes are labelled so that every child comes before its parent. Going up, a node's digest is a message to its parent's label, and a priority queue
ordered by label hands each parent the digests of its children. Going down, the labels are taken in reverse: a node hands each child the
siblings beside it and all that stands above, the suffix of the child's proof.

The queue is external: between blocks of 3^6 nodes of one level it is Spark's shuffle, sorted by label, so blocks are shared among tasks and a
level of any size spills; inside a block, where no more than 3^6 messages can wait, it is a heap. A tree of n leaves takes log(n) / log(3^6) rounds
each way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted
from .neardup import small

FAN = 3
HEIGHT = 6  # levels in a block
BLOCK = FAN**HEIGHT
#: A proof, from the leaf up: at each level the node's place in its run, and the run's other digests from left to right.
PROOF = "array<struct<slot:int,siblings:array<string>>>"
_PROOF = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def proof_digest(proof: Column) -> Column:
    """The hash of a proof's digests, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: p["siblings"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(own, p):
        left = F.array_join(F.slice(p["siblings"], F.lit(1), p["slot"]), "")
        right = F.array_join(F.slice(p["siblings"], p["slot"] + 1, F.size(p["siblings"])), "")
        return F.sha2(F.concat(left, own, right), 256)

    return F.aggregate(proof, leaf, up)


def raised(digests: list[str], alone: bool) -> list[list[str]]:
    """All levels of a block, its nodes' digests first. ``alone``: the block is its group's only one, and ends at one node; others go up HEIGHT levels.

    Labels are (level, place). The heap holds digests as messages to their parents and gives them up in the order of labels.
    """
    queue = [(1, i // FAN, i % FAN, d) for i, d in enumerate(digests)]
    levels, n, top = [digests], len(digests), 0
    while top < HEIGHT and not (alone and n == 1):
        n, top = -(-n // FAN), top + 1
    while queue and queue[0][0] <= top:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        if len(levels) == level:
            levels.append([])
        levels[level].append(own := hashed(run))
        heapq.heappush(queue, (level + 1, place // FAN, place % FAN, own))
    return levels


def lowered(levels: list[list[str]], suffix: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    """The proofs of a block's nodes, in order, from that of its root: labels in reverse, each node's message to its children being their suffixes."""
    top = len(levels) - 1
    queue = [(-top, 0, suffix)]
    while queue and queue[0][0] < 0:
        level, place, above = heapq.heappop(queue)
        first = place * FAN
        run = levels[-level - 1][first : first + FAN]
        for slot in range(len(run)):
            heapq.heappush(queue, (level + 1, first + slot, [(slot, run[:slot] + run[slot + 1 :]), *above]))
    while queue:
        yield heapq.heappop(queue)[2]


def _runs(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each block whole; the input is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        low = 0
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        for k, key in enumerate(own):
            if key != last:
                if k > low:
                    held.append(batch.slice(low, k - low))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, low, last = [], k, key
        if len(own) > low:
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _up(batches):
    """The root of each block."""
    for rows in _runs(batches, ["_g", "_block"]):
        n = rows.column("_n")[0].as_py()
        root = raised(rows.column("_digest").to_pylist(), n <= BLOCK)[-1][0]
        yield pa.RecordBatch.from_arrays([rows.column("_g").slice(0, 1), rows.column("_block").slice(0, 1), pa.array([-(-n // BLOCK)], pa.int64()), pa.array([root])], names=["_g", "_pos", "_n", "_digest"])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    cut = nodes.withColumn("_block", F.expr(f"_pos div {BLOCK}"))
    return cut.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos")


def _ranked(rows: DataFrame, order: list[str], group: list[str], label: str) -> DataFrame:
    """``rows`` with _pos, their place in their group from 0, and _n, its size. Groups of any size are dealt out by range; a range's rows are numbered on from the
    ranges before, of whose counts there is a row per range and group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = persisted(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), f"merkle-{label}")
    counts = ranged.groupBy("_part", *group).agg(F.count("*").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_own")
    counts = counts.select("_part", *group, before.alias("_before"), F.sum("_own").over(Window.partitionBy(*group)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return ranged.withColumn("_place", place).join(counts, ["_part", *group]).withColumn("_pos", (F.col("_place") - 1 + F.col("_before")).cast("bigint")).drop("_part", "_place", "_before")


class Tree:
    """The trees of all groups: ``nodes`` has a row (_g, _pos, _n, _digest) per leaf, and whatever else is to be handed back with its proof."""

    def __init__(self, nodes: DataFrame, label: str):
        self.label = label
        self.rounds = [nodes]
        most = nodes.agg(F.max("_n")).first()[0] or 0
        while most > 1:
            lower = self.rounds[-1].select("_g", "_pos", "_n", "_digest")
            schema = f"_g {lower.schema['_g'].dataType.simpleString()}, _pos bigint, _n bigint, _digest string"
            self.rounds.append(persisted(_in_blocks(lower).mapInArrow(_up, schema), f"merkle-{label}-up"))
            most = -(-most // BLOCK)

    def roots(self) -> DataFrame:
        """(_g, _digest): one row per group."""
        return self.rounds[-1].select("_g", "_digest")

    def proofs(self, suffixes: DataFrame) -> DataFrame:
        """The leaves with their _proof; ``suffixes`` (_g, _proof) are those of the groups' roots."""
        above = suffixes.select("_g", F.lit(0).cast("bigint").alias("_pos"), "_proof")
        if len(self.rounds) == 1:
            return self.rounds[0].join(above.drop("_pos"), "_g")
        for k in range(len(self.rounds) - 2, -1, -1):
            above = self._down(self.rounds[k], above)
            if k:
                above = persisted(above.select("_g", "_pos", "_proof"), f"merkle-{self.label}-down")
        return above

    @staticmethod
    def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
        """Messages to a block, the suffix of its root among them, meet by the shuffle's order: the suffix comes first, then the nodes by place."""
        message = above.select("_g", F.col("_pos").alias("_block"), F.lit(-1).cast("bigint").alias("_pos"), "_proof")
        own = nodes.withColumns({"_block": F.expr(f"_pos div {BLOCK}"), "_proof": F.lit(None).cast(PROOF)})
        both = own.unionByName(message, allowMissingColumns=True).repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos")
        at, names = own.columns.index("_proof"), own.columns

        def send(batches):
            for rows in _runs(batches, ["_g", "_block"]):
                suffix = [(p["slot"], p["siblings"]) for p in rows.column("_proof")[0].as_py()]
                rows = rows.slice(1)
                levels = raised(rows.column("_digest").to_pylist(), rows.column("_n")[0].as_py() <= BLOCK)
                told = pa.array([[{"slot": s, "siblings": x} for s, x in p] for p in lowered(levels, suffix)], _PROOF)
                yield pa.RecordBatch.from_arrays([told if i == at else rows.column(i) for i in range(len(names))], names=names)

        return both.select(names).mapInArrow(send, own.schema).drop("_block")


def manifest(rows: DataFrame, leaf: str = "leaf", group: str = "source", order: str = "doc_id") -> DataFrame:
    """``rows``, of which each is a leaf with the digest in column ``leaf``, with subroot, root and proof.

    Within a group leaves ascend by ``order``, nulls first; rows that tie are ordered by their digests. Groups are ordered by ``group`` as text, null first. While
    several nodes remain on a level, every three in a row become one, of which a rest of one or two is a run too. A proof has
    a level for each node from the leaf up, through its group's tree and that of the groups. Columns subroot, root and proof that are there already are
    replaced; all others stay, whatever their names. An empty table gives an empty result.
    """
    name = F.col(group).cast("string")
    held = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    key = F.struct(F.col(group).isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("name"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("_row"), key.alias("_g"), F.col(order).alias("_order"), F.col(leaf).alias("_digest"))
    # groups are named by a number that keeps their order
    ranked = _ranked(keyed, ["_order", "_digest"], ["_g"], "leaves")
    ids = persisted(_ranked(ranked.select("_g").distinct(), ["_g"], [], "groups").select("_g", F.col("_pos").alias("_id"), F.col("_n").alias("_groups")), "merkle-ids")
    nodes = persisted(ranked.join(small(ids, 100_000), "_g").select(F.col("_id").alias("_g"), "_pos", "_n", "_digest", "_row"), "merkle-nodes")

    within = Tree(nodes, "leaves")
    subroots = small(within.roots().withColumnRenamed("_digest", "_subroot"), 100_000)
    sizes = ids.select(F.col("_id").alias("_pos"), F.col("_groups").alias("_n"))
    tops = subroots.select(F.lit(0).cast("bigint").alias("_g"), F.col("_g").alias("_pos"), F.col("_subroot").alias("_digest")).join(sizes, "_pos")
    across = Tree(persisted(tops.select("_g", "_pos", "_n", "_digest"), "merkle-subroots"), "groups")
    start = across.roots().select("_g", F.array().cast(PROOF).alias("_proof"))
    suffixes = across.proofs(start).select(F.col("_pos").alias("_g"), "_proof")
    root = across.roots().select(F.col("_digest").alias("root"))  # one row, or none of an empty table
    told = within.proofs(persisted(suffixes, "merkle-suffixes")).join(subroots, "_g").join(F.broadcast(root), how="cross")
    return told.select("_row.*", F.col("_subroot").alias("subroot"), "root", F.col("_proof").alias("proof"))


DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def documents_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered, subroot, root, proof) of each document. ``tampered`` is the leaf of the row without its line feeds, for ids
    whose crc32 is even, else the leaf. A null id comes first and is never tampered with; a null text stays null; repeated rows are leaves of their own.
    """
    cols = [F.col(c) for c in DOCUMENT]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest(*cols).alias("leaf"), leaf_digest(*cols[:-1], text).alias("tampered"))
    return manifest(persisted(leaves, "merkle-digests"))


def verified(docs: DataFrame) -> DataFrame:
    """Each document's digests, and the root that its tampered row and its own proof lead to."""
    d = documents_manifest(docs)
    d = d.withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return d.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
