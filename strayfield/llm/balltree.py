"""Exact ranked lexical search by sparse ball trees.

A document is the sparse vector of its terms' contributions: weight of the term times its damped frequency, whole numbers. A query is the set of its
terms, and a document's score is the inner product of the two. Documents are read in bunches, and a bunch is a ball tree: a node has a centre and, in each
of several groups of terms, the radius around it that holds the node's documents. By Cauchy and Schwarz no document of a node scores
more than the centre's score plus, for each group, the radius times the root of the number of the query's terms in it. Bounds are rounded up by more than
double arithmetic can be off. A query goes through nodes best bound first, a node is split when it is first opened, leaves are scored in whole numbers, and
the search of a tree ends where no bound reaches the query's k-th best score so far. What a query has found in a task's earlier trees counts for the later ones.

Only terms of queries count, so vectors hold no others. Queries are taken in bunches of bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persisted

#: Bytes of terms, in lower case; all others part terms.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_KEPT).split() if text else []


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: the number of its terms, and the numbers of those in ``vocabulary`` with their frequencies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    number = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        get = number.value.get
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, at, tf, keep = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = terms(text)
                    keep.append(bool(own))
                    if own:
                        found = Counter(map(get, own))
                        found.pop(None, None)
                        n.append(len(own))
                        at.append(np.fromiter(found.keys(), np.int32, len(found)))
                        tf.append(np.fromiter(found.values(), np.int64, len(found)))
                ids = part.column("doc_id").filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, f"doc_id {kind}, n bigint, terms array<int>, tf array<bigint>")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the ``size`` terms. A task sums its own before anything is shuffled."""

    def count(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["at", "df"])

    df = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(count, "at int, df bigint").groupBy("at").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["at"]] = r["df"]
    return df


class Queries:
    """Term sets of queries, one behind the other, and the groups that terms fall into."""

    def __init__(self, sets: list[list[int]], size: int, groups: int):
        self.sets = [np.array(s, np.int64) for s in sets]
        self.groups = min(groups, max(1, size))
        self.flat = np.concatenate([*self.sets, np.zeros(0, np.int64)])
        self.starts = np.cumsum([0, *map(len, self.sets)])[:-1]
        # the root of the number of a query's terms in each group it touches
        self.touched, self.roots, self.touch_starts = [], [], []
        for s in self.sets:
            g, c = np.unique(s % self.groups, return_counts=True)
            self.touch_starts.append(len(self.touched))
            self.touched += g.tolist()
            self.roots += np.sqrt(c).tolist()
        self.touched, self.roots = np.array(self.touched, np.int64), np.array(self.roots)

    def bounds(self, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """No document of the ball scores more, for any query. Sums of double products of at most 2^31 terms are off by far less than the last factor."""
        middle = np.add.reduceat(centre[self.flat], self.starts)
        around = np.add.reduceat(radius[self.touched] * self.roots, self.touch_starts)
        return (middle + around) * (1 + 1e-6) + 1


class Ball:
    """Documents ``docs`` (numbers), their postings (``at`` the terms, ``y`` the contributions, row by row from ``starts``), and every query's bound on them."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, at: np.ndarray, y: np.ndarray, queries: Queries, size: int):
        self.docs, self.starts, self.at, self.y, self.queries, self.size = docs, starts, at, y, queries, size
        self.halves: tuple[Ball, Ball] | None = None
        n, g = len(docs), queries.groups
        self.row = np.repeat(np.arange(n), np.diff(starts))
        value = y.astype(np.float64)
        self.centre = np.bincount(at, value, size) / n
        own = self.centre[at]
        # squared distances per document and group: the centre's square, less what the postings change of it
        square = np.bincount(np.arange(size) % g, self.centre**2, g)
        cell = self.row * g + at % g
        change = np.bincount(cell, value * (value - 2 * own), n * g).reshape(n, g)
        # what rounding can have cost: a share of all that was summed
        summed = np.bincount(cell, value * (value + 2 * own), n * g).reshape(n, g)
        radius = np.sqrt(np.maximum(0, square + change) + 1e-9 * (square + summed)).max(0)
        self.bounds = queries.bounds(self.centre, radius)

    def distances(self, to: np.ndarray) -> np.ndarray:
        """Of each document, squared, less the square of ``to``."""
        return np.bincount(self.row, self.y * (self.y - 2 * to[self.at]), len(self.docs))

    def vector(self, k: int) -> np.ndarray:
        own = slice(self.starts[k], self.starts[k + 1])
        return np.bincount(self.at[own], self.y[own].astype(np.float64), self.size)

    def split(self) -> tuple[Ball, Ball]:
        """Halves: the document farthest from the centre, the one farthest from that, and all others by which of the two is nearer."""
        if self.halves is None:
            one = self.vector(int(np.argmax(self.distances(self.centre))))
            near_one = self.distances(one)
            two = self.vector(int(np.argmax(near_one)))
            order = np.argsort(near_one - self.distances(two), kind="stable")
            middle = len(order) // 2
            self.halves = tuple(self.part(np.sort(x)) for x in (order[:middle], order[middle:]))
            self.row = self.centre = None
        return self.halves

    def part(self, rows: np.ndarray) -> Ball:
        n = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(self.starts[rows] - starts[:-1], n) + np.arange(starts[-1])
        return Ball(self.docs[rows], starts, self.at[take], self.y[take], self.queries, self.size)

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """The documents' whole-number scores; ``wanted`` marks the query's terms."""
        sums = np.concatenate([[0], np.cumsum(np.where(wanted[self.at], self.y, 0))])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def search_tree(root: Ball, query: int, wanted: np.ndarray, best: list, k: int, leaf: int, place) -> int:
    """Add to ``best``, a heap of (score, place) of the k best documents so far. Gives the number of documents scored.

    ``place`` gives a document's order among equal scores, the larger the better; equal bounds are followed, as a tie may be won.
    """
    opened = 0
    heap = [(-root.bounds[query], 0, root)]
    pushed = 0
    while heap:
        bound, _, ball = heapq.heappop(heap)
        if len(best) == k and -bound < best[0][0]:
            break
        if len(ball.docs) > leaf:
            for half in ball.split():
                pushed += 1
                heapq.heappush(heap, (-half.bounds[query], pushed, half))
            continue
        opened += len(ball.docs)
        scores = ball.scores(wanted)
        for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
            found = (int(scores[i]), place(int(ball.docs[i])))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
    return opened


class Last:
    """An id in descending order, null least of all: the heap's order among equal scores."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: Last) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other) -> bool:
        return self.id == other.id


def ranked(found: DataFrame, sets: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, leaf: int, tree_docs: int, tree_postings: int, groups: int) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of each query, a query being its place in ``sets``; and a row of query -1, score documents scored."""
    kind = found.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else None
    given = found.sparkSession.sparkContext.broadcast((sets, weights))

    def bunches(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, n, and postings of as many documents as make a tree."""
        for batch in batches:
            low = 0
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = min(low + tree_docs, max(low + 1, int(np.searchsorted(ends, before + tree_postings, "right"))), batch.num_rows)
                part = batch.slice(low, high - low)
                starts = np.concatenate([[0], ends[low:high] - before])
                yield part.column("doc_id").to_pylist(), part.column("n").to_numpy(), starts, part.column("terms").flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                low = high

    def search(batches):
        sets, weights = given.value
        size = len(weights)
        asked = [q for q, s in enumerate(sets) if s]
        queries = Queries([sets[q] for q in asked], size, groups)
        best: list[list] = [[] for _ in asked]
        opened = 0
        for ids, n, starts, at, tf in bunches(batches):
            if not asked:
                break
            damp = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
            y = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(damp, np.diff(starts))))
            root = Ball(np.arange(len(ids)), starts, at.astype(np.int64), y, queries, size)
            wanted = np.zeros(size, bool)
            for q, own in enumerate(best):
                if len(own) < k or root.bounds[q] >= own[0][0]:
                    wanted[queries.sets[q]] = True
                    opened += search_tree(root, q, wanted, own, k, leaf, lambda i: Last(ids[i]))
                    wanted[queries.sets[q]] = False
        rows = [(asked[q], p.id, s) for q, own in enumerate(best) for s, p in own] + [(-1, None, opened)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return found.mapInArrow(search, f"query int, doc_id {kind}, score bigint")


def bunched(items: Iterator, most: int) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """Queries in bunches of at most ``most`` distinct terms, or of one query: their ids, their term sets, and the terms' numbers."""
    ids, sets, number = [], [], {}
    for item in items:
        own = dict.fromkeys(terms(item["text"]))
        if ids and len(number) + len(own) > most:
            yield ids, sets, number
            ids, sets, number = [], [], {}
        ids.append(item["item_id"])
        sets.append([number.setdefault(t, len(number)) for t in own])
    if ids:
        yield ids, sets, number


def search(docs: DataFrame, items: DataFrame, k: int = 10, leaf: int = 16, tree_docs: int = 2048, tree_postings: int = 4_000_000, groups: int = 2048, bunch_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score most, above 0, for each row of ``items`` (item_id, text); equal scores by ascending doc_id.

    Exact. A null or wordless text of a document is in no count and no result, that of an item has no results. Rows that repeat an id are documents, or items, of
    their own; a document without an id comes last among equal scores. Empty tables give an empty result; other columns are ignored.

    Items come to the driver in bunches of ``bunch_terms`` distinct terms at most (an item of more terms is a bunch of its own); each bunch reads all documents.
    A task holds a tree of at most ``tree_docs`` documents and ``tree_postings`` postings (or one document), and k documents for each item of a bunch.
    """
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    given = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).toLocalIterator()
    for ids, sets, number in bunched(given, bunch_terms):
        found = persisted(vectors(docs, number), "balltree-vectors")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(found, len(number))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        best = ranked(found, sets, weights, n_docs, max(n_terms, 1), k, leaf, tree_docs, tree_postings, groups).where("query >= 0")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {kind}")  # one row per item of a bunch
        told = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = told if out is None else out.unionByName(told)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return out
