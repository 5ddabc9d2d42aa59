"""Merkle manifests, SimHash groups and ranked search against plain Python, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from strayfield.llm import queries

SF = f"{DATA}/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _g string, root string, query string, fp string"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "One short line.\n", "en", None), (4, "One short line.\n", "en", None), (5, "One\nshort line.", "fr", "b"), (None, "No id here at all, mail x.y@z.example now.", None, "b"),
    (6, "word " * 60_000, "en", "a"), (7, "é日😀 1.2.3.4 +1 (555) 123-4567 ..", "de", "c"), (8, "1234567890" * 3000, None, "é"), (9, "a@" * 500 + "b.c", "xx", ""), (10, "no full stop " * 40, "en", "a"), (11, "....\n\n..", "en", "a"), (4, "Two rows of one id", "en", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z", "w", "v") for i, t, lang, s in ODD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 11 -----------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's proof: per level its place in the run and the others."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([digest(*own[k : k + 3]) for k in range(0, len(own), 3)])
    proofs = []
    for k in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            run, slot = level[k - k % 3 : k - k % 3 + 3], k % 3
            proof.append((slot, run[:slot] + run[slot + 1 :]))
            k //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def forest(rows):
    """From (source, doc_id, leaf) a Counter of (source, doc_id, leaf, subroot, root, proof)."""
    key = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    sources = sorted({s for s, *_ in rows}, key=key)
    own = {s: sorted(((d, leaf) for x, d, leaf in rows if x == s), key=lambda r: (key(r[0]), r[1])) for s in sources}
    trees = {s: tree([leaf for _, leaf in own[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    shown = lambda p: tuple((slot, tuple(x)) for slot, x in p)
    return Counter((s, d, leaf, trees[s][0], root, shown(p + top)) for s, top in zip(sources, tops, strict=True) for (d, leaf), p in zip(own[s], trees[s][1], strict=True))


def test_proofs_of_trees_of_many_sizes(spark):
    """Groups of one leaf, of just a block, of one more, and of three rounds of blocks when these are small."""
    from strayfield.llm.merkle import folded, manifest

    sizes = {None: 3, "": 1, "a": 2000, "b": 1, "c": 729, "d": 730, "é": 2188, "z": 2}
    rows = [(s, k, digest(str(s), str(k))) for s, n in sizes.items() for k in range(n)] + [("a", 5, digest("again"))]
    d = spark.createDataFrame(rows, "source string, doc_id bigint, leaf string").repartition(7)
    got = manifest(d).withColumn("up", folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.up == r.root for r in got)
    assert Counter((r.source, r.doc_id, r.leaf, r.subroot, r.root, tuple((p.slot, tuple(p.siblings)) for p in r.proof)) for r in got) == forest(rows)


def test_many_groups(spark):
    from strayfield.llm.merkle import manifest

    rows = [(f"s{k % 900}", k, digest(str(k))) for k in range(1500)]
    got = manifest(spark.createDataFrame(rows, "source string, doc_id bigint, leaf string")).collect()
    assert Counter((r.source, r.doc_id, r.leaf, r.subroot, r.root, tuple((p.slot, tuple(p.siblings)) for p in r.proof)) for r in got) == forest(rows)


def test_manifest_of_odd_tables(odd, empty):
    from strayfield.llm.merkle import documents_manifest, verified

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s: digest(*map(field, (i, s, lang, len(t or ""), t)))
    want = forest([(s, i, leaf(i, t, lang, s)) for i, t, lang, s in ODD])
    got = documents_manifest(odd).collect()
    assert Counter((r.source, r.doc_id, r.leaf, r.subroot, r.root, tuple((p.slot, tuple(p.siblings)) for p in r.proof)) for r in got) == want
    for r in verified(odd).collect():  # only those that lose a line feed fail
        texts = [t for i, t, *_ in ODD if i == r.doc_id]
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.verified or changed and any("\n" in (t or "") for t in texts)
    assert not all(r.verified for r in verified(odd).collect())
    assert verified(empty).count() == 0


# 12 -----------------------------------------------------------------


def simhash(text, size=3):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    ones = Counter(b for s in shingles for h in [xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(rows, most=3):
    """(doc_id, fingerprint): the smallest id reachable, rows of one id being one document."""
    up = {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, f) in enumerate(rows):
        for b, g in rows[k + 1 :]:
            if (f ^ g).bit_count() <= most:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in up}


@pytest.mark.parametrize("sf", ["sf0.001", "odd"])
def test_simhash_groups(spark, odd, sf):
    from strayfield.llm.simhash import near_duplicates

    d = odd if sf == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    prints = [(i, simhash(t)) for i, t in texts]
    want = groups([x for x in prints if x[0] is not None]) | {None: None}
    assert Counter(map(tuple, near_duplicates(d).collect())) == Counter((i, f"{f:016x}", want[i]) for i, f in prints)


@pytest.mark.parametrize("block", [2048, 7])
def test_links_of_dense_and_random_fingerprints(spark, block):
    """A ball of fingerprints, chains of three bits a step, and random ones, by buckets in one block or in many."""
    from strayfield.llm import simhash as S

    rng = random.Random(12)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(300)}
    step = rng.getrandbits(64)
    for _ in range(10):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.add(step)
    rows = list(enumerate(sorted(prints)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    d = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    of = {r.node: r.component for r in S.components(S.links(d, 3, block)).collect()}
    got, want = {}, groups(rows)
    for i, f in signed:
        got.setdefault(of.get(f, f), set()).add(i)
    same: dict = {}
    for i, c in want.items():
        same.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same.values()))


def test_plans_keep_the_pigeonhole_sum_and_follow_the_counts():
    import numpy as np

    from strayfield.llm.simhash import allotted, grouped, masks, planned

    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (100, 10**6, 10**8, 10**10):
        plan = planned(n, both * n, 3)
        bits = sorted(b for own, _ in plan for b in own)
        assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in plan) == 4
        assert len(masks(plan)) == sum(math.comb(len(own), t) for own, t in plan)
    both[:4, :4] = 0.5  # four bits that are always alike share a part
    assert any({0, 1, 2, 3} <= set(g) for g in grouped(np.abs(both - 0.25) * (1 - np.eye(64)), 4))
    rng = random.Random(3)
    costs = [[0.0] + [rng.random() for _ in range(4)] for _ in range(3)]
    every = [sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in ((a, b, 1 - a - b) for a in range(-1, 4) for b in range(-1, 4)) if -1 <= ts[2] <= 3]
    assert allotted(costs, 1)[0] == pytest.approx(min(every))


def test_simhash_of_an_empty_table(empty):
    from strayfield.llm.simhash import near_duplicates

    assert near_duplicates(empty).count() == 0


# 13 -----------------------------------------------------------------


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=10):
    own = [(i, Counter(w), len(w)) for i, t in docs if (w := cut(t))]
    n, total = len(own), sum(m for *_, m in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = Counter()
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(cut(text))}
        scored = [(sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * m * n // total))) for t, w in asked.items() if t in c), i) for i, c, m in own]
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out.update((item, rank, i, s) for rank, (s, i) in enumerate(best, 1))
    return out


ITEMS = [(1, "short line one"), (2, None), (3, "..."), (4, "word word mail é日😀"), (4, "no full stop"), (None, "No id here"), (5, "absent terms only qqq"), (6, "word " * 50_000), (7, "1 2 3 4 555 a b c")]


@pytest.mark.parametrize("more", [{}, {"leaf": 1, "tree_docs": 3, "groups": 4}, {"bunch_terms": 4, "tree_postings": 5}])
def test_search_of_odd_tables(spark, odd, empty, more):
    from strayfield.llm.balltree import search

    items = spark.createDataFrame([(*x, "y") for x in ITEMS], "item_id bigint, text string, doc_id string")
    got = Counter(map(tuple, search(odd, items, **more).collect()))
    assert got == ranking([(i, t) for i, t, *_ in ODD], ITEMS)
    assert search(empty, items, **more).count() == 0 and search(odd, items.where("false"), **more).count() == 0


def test_search_is_exact_among_ties_and_copies(spark):
    """Many equal scores: the smallest ids win, however trees are cut."""
    from strayfield.llm.balltree import search

    rng = random.Random(13)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words[: 5 + k % 55]) for _ in range(rng.randrange(12)))) for k in range(900)] + [(2000 + k, "w1 w2 w3") for k in range(40)]
    items = [(k, " ".join(rng.sample(words, 6))) for k in range(20)] + [(99, "w1 w2 w3")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    t = spark.createDataFrame(items, "item_id bigint, text string")
    for more in ({}, {"leaf": 2, "tree_docs": 100, "groups": 8}):
        assert Counter(map(tuple, search(d, t, **more).collect())) == ranking(docs, items)


def test_bounds_hold_and_prune():
    """No document of any ball scores more than its bound, and few leaves are opened for a planted text."""
    import numpy as np

    from strayfield.llm.balltree import Ball, Last, Queries, search_tree

    rng = np.random.default_rng(1)
    size, n = 400, 300
    rows = [np.unique(rng.integers(0, size, rng.integers(1, 30))) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at, y = np.concatenate(rows), rng.integers(1, 10**10, starts[-1])
    sets = [rows[k].tolist() for k in range(0, n, 30)]
    q = Queries(sets, size, 128)
    root = Ball(np.arange(n), starts, at, y, q, size)
    todo = [root]
    while todo:
        ball = todo.pop()
        for k, own in enumerate(sets):
            wanted = np.isin(np.arange(size), own)
            assert ball.scores(wanted).max() <= ball.bounds[k]
        if len(ball.docs) > 4:
            todo += ball.split()
    opened = [search_tree(root, k, np.isin(np.arange(size), s), [], 1, 4, Last) for k, s in enumerate(sets)]
    assert sum(opened) < 0.5 * n * len(sets)


def test_queries_read_the_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.op12_simhash(spark, SF).count() == docs.count()
    got = queries.op13_ranked_search(spark, SF).collect()
    assert Counter(map(tuple, got)) == ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
