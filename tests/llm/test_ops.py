"""The training-data operators against plain Python, round trips and held-out accuracy, and on odd tables."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from strayfield.llm import queries

SF = f"{DATA}/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, score string, key string, size string"
LONG = "word " * 60_000
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "One short line.", "en", None), (4, "One short line.", "en", None), (5, "One short line.", "fr", "b"), (None, "No id here at all, mail x.y@z.example now.", None, "b"),
    (6, LONG, "en", "a"), (7, "é日😀 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111 ..", "de", "c"), (8, "1234567890" * 3000, None, "c"), (9, "a@" * 500 + "b.c", "xx", "a"), (10, "no full stop " * 40, "en", "a"), (11, "....\n\n..", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z", "w") for i, t, lang, s in ODD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, SF), oracle(queries.ORACLES[name], "sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


# 1 ------------------------------------------------------------------


def contaminated(spark, docs, items, **more):
    from strayfield.llm.decontam import contamination

    got = contamination(docs, items, **more)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=str)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_contamination_with_short_and_odd_items(spark, odd, texts, broadcast):
    items = [(1, "Short words"), (2, None), (3, ""), (4, "one two three four five six seven eight nine TEN eleven"), (5, "word " * 12), (6, "short line"), (6, "no full stop"), (None, "short line"), (7, "1")]
    own = [(i, t) for i, t, *_ in ODD] + [(20, "zero One two, three four five six seven eight nine ten. Short words! one two three four five six seven eight nine ten eleven")]
    d = odd.unionByName(spark.createDataFrame([own[-1]], "doc_id bigint, text string"), allowMissingColumns=True)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute.contamination(own, [x for x in items if x[0] is not None]), key=str)
    assert contaminated(spark, d, table, broadcast_prints=broadcast) == want


def test_contamination_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(x[5] for x in contaminated(spark, odd, items))
    assert contaminated(spark, empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")) == []


def test_clean_drops_only_what_is_contaminated(spark):
    from strayfield.llm.decontam import clean

    d = spark.createDataFrame([(1, "a b c d"), (1, "x"), (None, "a b c d"), (None, "y")], "doc_id bigint, text string")
    assert sorted(r.text for r in clean(d, spark.createDataFrame([(1, "b c")], "item_id bigint, text string")).collect()) == ["x", "y"]


# 2 ------------------------------------------------------------------


def auc(pairs):
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark):
    d = f"{DATA}/sf0.1"
    got = queries.op2_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "quality").collect()
    assert auc([(r.score, r.quality) for r in got]) > 0.97
    assert sum((r.score >= 0.7) == r.quality for r in got) > 0.95 * len(got)


def test_quality_of_odd_tables(spark, odd, empty, docs):
    from strayfield.llm.quality import classify, fit

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels)
    got = classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert classify(empty, model).count() == 0
    assert {r.score for r in classify(odd, fit(docs, labels.where("false"))).collect()} == {0.5}


# 3 ------------------------------------------------------------------


def test_archives_with_copies_and_odd_pages(spark, tmp_path):
    from strayfield.llm import warc

    big, other = "<p>x</p>" * 200, "é" * 700
    pages = [(1, "http://a/", big), (2, "http://b/ \r\nX: y", big), (2, "http://b/", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", other), (9, "u", other), (8, "u", "a\r\n\r\nb" * 300)]
    table = spark.createDataFrame([(*p, "c") for p in pages], "page_id bigint, url string, html string, payload string")
    bundles = warc.write_archives(table, f"file://{tmp_path}/w", frame_bytes=2000, bundle_bytes=6000)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(bundles).collect()}
    last = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    want = {(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if last.get(h, i) != i else "response", last[h] if last.get(h, i) != i else None) for i, _, h in pages}
    assert got == want and sum(r.n_records for r in bundles.collect()) == len(pages)
    for r in bundles.collect():  # random access to each record
        reader = warc.BundleReader(r.bundle)
        for record_id in reader.index():
            assert all(head["warc-record-id"] == f"<{record_id}>" for head, _ in reader.find(record_id))
        assert reader.find("urn:page:none") == []
    assert sum(len(warc.find_records(r.bundle, 2)) for r in bundles.collect()) == sum(i == 2 for i, *_ in pages)


def test_salted_revisits_are_the_broadcast_ones(spark, docs):
    from strayfield.llm.warc import with_revisits

    pages = docs.select((F.col("doc_id")).alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    one, two = (sorted(map(tuple, with_revisits(pages, 1, n).select("page_id", "refers_to").collect()), key=str) for n in (100_000, 0))
    assert one == two and any(r[1] is not None for r in one)


def test_archives_of_text_ids_and_a_long_page(spark):
    from strayfield.llm.warc import round_trip

    d = spark.createDataFrame([("a\tb", "http://x/" + "y" * 100_000, "z" * 3_000_000), ("c", None, "z" * 3_000_000), (None, "u", "")], "page_id string, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in round_trip(d).collect()}
    assert got == {("a\tb", 3_000_000, "revisit", "c"), ("c", 3_000_000, "response", None), (None, 0, "response", None)}


def test_archives_of_no_pages(spark):
    from strayfield.llm.warc import round_trip

    assert round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 4 ------------------------------------------------------------------


def test_near_duplicates_are_those_of_all_pairs(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_duplicates(spark, SF).collect()}
    assert got == brute.near_duplicates(texts, 4, 80)


def test_near_duplicates_in_chains_and_odd_tables(spark, odd, empty):
    from strayfield.llm.neardup import near_duplicates

    rng = random.Random(4)
    base, chain = [f"w{rng.randrange(10**6)}" for _ in range(120)], []
    for k in range(12):  # each is near the one before, the ends are far apart
        base = base[:]
        base[(10 * k + 5) % 120] = f"x{k}"
        chain.append((100 - k, " ".join(base)))
    d = odd.where("doc_id is not null").unionByName(spark.createDataFrame(chain, "doc_id bigint, text string"), allowMissingColumns=True)
    want = brute.near_duplicates([(i, t) for i, t, *_ in ODD if i is not None] + chain, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d).collect()}
    assert got == want and len({c for i, (_, c, _) in got.items() if i > 80}) == 1
    assert near_duplicates(empty).count() == 0
    null = near_duplicates(odd).where("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in null] == [(None, True)]


def test_a_group_of_ten_thousand_and_repeated_ids(spark):
    """Copies that differ in one of 80 words: one group. Rows that repeat an id go or stay together."""
    from strayfield.llm.neardup import deduplicated, near_duplicates

    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    made = [(k, " ".join(base[: k % 80] + [f"x{k}"] + base[k % 80 + 1 :])) for k in range(1000, 11_000)]
    other = " ".join(f"o{k}" for k in range(50))
    d = spark.createDataFrame([*made, (5, " ".join(base)), (2000, other), (2000, other), (3000, other), (20_000, other), (9, "short"), (9, "short"), (None, None)], "doc_id bigint, text string")
    got = {r.component_id for r in near_duplicates(d).where("doc_id >= 1000").collect()}
    assert got == {5}
    assert sorted(((r.doc_id, r.text) for r in deduplicated(d).collect()), key=str) == sorted([(5, " ".join(base)), (9, "short"), (None, None)], key=str)


# 5 ------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    got = queries.op5_language_id(spark, f"{DATA}/sf0.01").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.98 * len(got)


def test_language_of_odd_tables(spark, odd, empty, docs):
    from strayfield.llm.language_id import identify, learned

    model = learned(docs)
    got = identify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 8, 11}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert identify(empty, model).count() == 0
    assert {r.lang_pred for r in identify(odd, learned(empty)).collect()} == {"und"}


# 6 ------------------------------------------------------------------


def test_base_spans(spark, odd, texts):
    from strayfield.llm.pii import personal_data

    got = queries.op6_pii(spark, SF).collect()
    want = dict(texts)
    assert len(got) == len(want) and all(r.base_sha256 == brute.base_sha256(want[r.doc_id]) for r in got)
    rng = random.Random(6)
    alphabet = ["@", ".", "-", "+", " ", "a", "B", "_", "%", "1", "25", "555", "(", ")", "é", "😀", "\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 555 123 4567", "0"]
    made = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for k in range(1500)]
    d = spark.createDataFrame(made, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    want = Counter((i, brute.base_sha256(t), Counter(s[2] for s in brute.base_spans(t))["card"]) for i, t in made + [(i, t) for i, t, *_ in ODD])
    assert Counter((r.doc_id, r.base_sha256, r.n_card) for r in personal_data(d).collect()) == want


def test_words_that_give_an_entity_away(spark, empty):
    from strayfield.llm.pii import Disclosure, personal_data, sanitised

    fill = [f"filler{k}" for k in range(60)]
    rng = random.Random(2)
    said = lambda: " ".join(rng.sample(fill, 12))
    made = [(k, f"{said()} Zorblatt z.b@mail.example {said()}") for k in range(6)] + [(50 + k, said() + " x" + str(k)) for k in range(300)]
    made += [(400, "again Zorblatt " + said()), (401, None)]
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    got = {r.doc_id: r for r in personal_data(d).collect()}
    assert all(got[k].n_email == 1 and got[k].n_term == 1 for k in range(6)) and got[400].n_term == 1 and got[400].spans == "term:6:14"
    assert not any(got[50 + k].spans for k in range(300)) and got[401].spans == ""
    clean = {r.doc_id: r.text for r in sanitised(d).collect()}
    assert clean[400].startswith("again [TERM] ") and "[TERM] [EMAIL]" in clean[0] and clean[401] is None and clean[50] == made[6][1]
    copies = spark.createDataFrame([(k, made[0][1]) for k in range(20)] + made[6:306], "doc_id bigint, text string")
    found = {r.doc_id: r.n_term for r in personal_data(copies).collect()}
    # copies are one text: enough for a name that stands nowhere else, unless two are asked for
    assert all(found[k] == (k < 20) for k in found)
    assert not any(r.n_term for r in personal_data(copies, Disclosure(posterior=0.6)).collect())
    assert personal_data(empty).count() == 0


def test_spans_are_those_of_plain_python(spark, texts, odd):
    """Disclosing words too, of which the given table has some, beside words of any length, with many of them in one text, and across the marks of the word index."""
    from strayfield.llm.pii import personal_data

    got = {r.doc_id: r.spans for r in queries.op6_pii(spark, SF).collect()}
    want, telling = brute.all_spans(texts)
    assert got == dict(zip([i for i, _ in texts], want, strict=True))
    larger = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, telling = brute.all_spans(larger)
    assert telling and {r.doc_id: r.spans for r in queries.op6_pii(spark, f"{DATA}/sf0.01").collect()} == dict(zip([i for i, _ in larger], want, strict=True))
    rng = random.Random(9)
    fill = [f"filler{k}" for k in range(60)]
    said = lambda n=9: " ".join(rng.sample(fill, n))
    made = [(k, f"{said()} Zorblatt {'w' * 400} z.b@mail.example {'v' * 400}, Quux {said()}") for k in range(6)]
    made += [(10 + k, f"{said(3)} éa@b.ex, 1.2.3.{k % 2} Ünik {said(2)}") for k in range(5)]
    made += [(20, "ünik " + " ".join(rng.choice([*fill, "Zorblatt", "zorblatt", "x@y.example", "+1 555 123 4567"]) for _ in range(1500)))]
    made += [(100 + k, said() + " x" + str(k)) for k in range(300)] + [(500, None), (501, "quux"), (501, "quux")]
    both = made + [(i, t) for i, t, *_ in ODD]
    want, telling = brute.all_spans(both)
    assert {"zorblatt", "w" * 400, "v" * 400} <= telling
    d = spark.createDataFrame(made, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.spans) for r in personal_data(d).collect())
    assert got == Counter((i, s) for (i, _), s in zip(both, want, strict=True))


def test_sanitised_keeps_columns_of_any_name(spark, empty):
    from strayfield.llm.pii import sanitised

    kind = "_row int, _spans string, _words string, text string, _null string, c0 string, _doc string, _hit string, _own string"
    d = spark.createDataFrame([(1, "s", "w", "mail a@b.c now", "n", "c", "d", "h", "o"), (2, None, None, None, None, None, None, None, None)], kind)
    got = sorted(tuple(r) for r in sanitised(d).collect())
    assert got == [(1, "s", "w", "mail [EMAIL] now", "n", "c", "d", "h", "o"), (2, *[None] * 8)] and sanitised(d).columns == d.columns
    assert sanitised(empty).count() == 0 and sanitised(empty).columns == empty.columns


# 7 ------------------------------------------------------------------


def test_token_counts_are_the_library_s(spark, odd, empty, texts):
    import sentencepiece

    from strayfield.llm.token_count import count_tokens, model_path

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    rng = random.Random(7)
    made = [(k, "".join(rng.choice("  \n\ta▁bthe e1éß日😀.<s>\x00\u3000 ") for _ in range(rng.randrange(80)))) for k in range(800)] + [(k, " " * k + "x" + " " * k) for k in range(70)]
    d = spark.createDataFrame(made, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    want = Counter((i, len(t.encode()) if t else 0, len(lib.encode(t)) if t else 0) for i, t in made + [(i, t) for i, t, *_ in ODD])
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(d, remembered=500).collect()) == want
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op7_token_count(spark, SF).collect()}
    assert got == {i: (n := len(lib.encode(t)), n > 4096) for i, t in texts}
    assert count_tokens(empty).count() == 0


# 8 ------------------------------------------------------------------


def edited(texts):
    out = {}
    order = sorted(texts, key=lambda x: x[0])
    for k, (i, t) in enumerate(order):
        t, n = t or "", (order[(k + 1) % len(order)][1] or "")
        cut = len(t) // 4
        out[i] = (len(t), t[: len(t) - cut] + n[:cut], t)
    return out


def test_fingerprints_of_edited_texts(spark, texts):
    got, want = {r.doc_id: r for r in queries.op8_fingerprint(spark, SF).collect()}, edited(texts)
    assert len(got) == len(want)
    prints: dict = {}
    for i, (n, e, t) in want.items():
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        prints.setdefault(t, set()).add(got[i].fingerprint)
        prints.setdefault(e, set()).add(got[i].edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    near = sorted(got[i].near_edited for i in got)
    assert near[len(near) // 2] > 0.6 and sum(got[i].near_edited > got[i].near_next for i in got) > 0.9 * len(got)


def test_fingerprints_are_homomorphic(spark):
    from strayfield.llm.fingerprint import fingerprints

    d = spark.createDataFrame([(1, "a b.\nc d.\ne f.\n"), (2, "e f.\nc d.\na b.\n"), (3, "a b.\nc d.\n"), (4, "e f.\n"), (5, "")], "k int, text string")
    v = {r.k: [r.n_pieces, *r.vec] for r in fingerprints(d, ["k"]).collect()}
    added = [(a + b) % 2**40 if 1 <= k <= 4 else a + b for k, (a, b) in enumerate(zip(v[3], v[4], strict=True))]
    assert added == v[1] == v[2] != v[3] and not any(v[5])
    again = spark.createDataFrame([(1, "c d.\na b.\n")], "k int, text string")
    assert [[r.n_pieces, *r.vec] for r in fingerprints(again, ["k"]).collect()] == [v[3]]


def test_fingerprints_of_inserted_and_removed_pieces(spark):
    from strayfield.llm.fingerprint import fingerprints, inserted, removed

    kind = "k int, text string"
    prints = lambda *rows: fingerprints(spark.createDataFrame(rows, kind), ["k"])
    shown = lambda d: {r.k: (r.n_pieces, list(r.vec)) for r in d.collect()}
    whole, part, rest = prints((1, "a b.\nc d.\ne f."), (2, "x.")), prints((1, "c d.\n")), prints((1, "a b.\ne f."), (2, "x."))
    assert shown(inserted(rest, part, "k")) == shown(whole) and shown(removed(whole, part, "k")) == shown(rest)


def test_likeness_follows_shared_pieces(spark):
    """The angle between the true counts of pieces, within the documented error."""
    import math

    import re

    from strayfield.llm.fingerprint import PIECE, dot, fingerprints, likeness

    rng = random.Random(12)
    made = [[f"line {rng.randrange(50 if k % 2 else 10**6)}" for _ in range(60)] for k in range(40)]
    made += [own[: 6 * k] + [f"other {rng.random()}" for _ in range(60 - 6 * k)] for k, own in enumerate(made[:10])]
    made = ["\n".join(own) + "\n" for own in made] + ["see a.example.org. It is 0.5 more. ", "It is 0.5 more. See e.g. b.example."]
    v = fingerprints(spark.createDataFrame(list(enumerate(made)), "k int, text string"), ["k"])
    v = v.withColumn("norm", dot(F.col("vec"), F.col("n_pieces"), F.col("vec"), F.col("n_pieces")))
    side = lambda c: v.select(F.col("k").alias(c), F.struct(F.col("n_pieces").alias("n"), "vec", "norm").alias(f"v{c}"))
    parts = lambda c: {x: F.col(f"v{c}.{x}") for x in ("n", "vec", "norm")}
    off = []
    for r in side("a").crossJoin(side("b")).where("a < b").select("a", "b", likeness(parts("a"), parts("b")).alias("x")).collect():
        x, y = Counter(re.findall(PIECE, made[r.a])), Counter(re.findall(PIECE, made[r.b]))
        true = sum(x[p] * y[p] for p in x) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        off.append(abs(r.x - true))
    assert max(off) < 0.5 and sum(off) / len(off) < 0.1


def test_fingerprints_of_a_text_of_ten_million_pieces(spark, tmp_path):
    """Read from a table: as literals, Spark would fold the pieces into one array and send it with every task."""
    from strayfield.llm.fingerprint import fingerprints

    n = 10_000_000
    spark.range(1).select(F.lit(1).alias("k"), F.repeat(F.lit("\n"), F.lit(n)).alias("text")).write.parquet(f"file://{tmp_path}/t")
    d = spark.read.parquet(f"file://{tmp_path}/t")
    r, one = fingerprints(d, ["k"]).first(), fingerprints(spark.createDataFrame([(1, "\n")], "k int, text string"), ["k"]).first()
    assert r.n_pieces == n and list(r.vec[:4]) == [x * n % 2**40 for x in one.vec[:4]]
    assert [x % 2**40 for x in r.vec[4:]] == [x % 2**40 * n % 2**40 for x in one.vec[4:]] and [x >> 40 for x in r.vec[4:]] == [(x >> 40) * n % 2**20 for x in one.vec[4:]]


def test_fingerprints_of_odd_tables(spark, odd, empty):
    from strayfield.llm.fingerprint import edited_fingerprints

    got = edited_fingerprints(odd).collect()
    assert len(got) == len(ODD) and Counter(r.doc_id for r in got) == Counter(i for i, *_ in ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars == 0 and by[1].near_next == 1 and by[1].fingerprint == by[2].fingerprint
    assert by[4].fingerprint == by[5].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edited_fingerprints(empty).count() == 0


# 9 ------------------------------------------------------------------


def water(sizes, weights, most=3):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_mix(spark, odd, empty, docs):
    import re

    from strayfield.llm.mixing import Mix

    for d in (docs, odd):
        got = Mix(d, block=16).documents().collect()
        src = d.select("doc_id", "source", "text").collect()
        size = Counter()
        for r in src:
            size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        names = sorted(size, key=lambda s: (s is None, s or ""))
        target = dict(zip(names, water([size[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
        taken = Counter()
        for r in got:
            assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert len(got) == len(src) and all(abs(taken[s] - target[s]) <= 1 for s in names)
        again = Mix(d, block=16).documents().collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert Mix(empty).documents().count() == 0
    nothing = Mix(odd.where("doc_id in (1, 2)")).documents().collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_mix_is_the_same_however_the_table_is_cut(spark, docs, odd):
    from strayfield.llm.mixing import Mix

    for d in (docs, odd):
        taken = lambda x: Counter((r.doc_id, r.size, r.target, r.taken, r.source) for r in Mix(x, block=16, task_slots=500).documents().collect())
        want = taken(d.coalesce(1))
        for cut in (d.repartition(3), d.repartition(7, F.rand(1)), d.orderBy(F.rand(2)), d.repartitionByRange(5, F.desc("text"))):
            assert taken(cut) == want


def test_slots_are_within_their_documents(spark, docs):
    from strayfield.llm.mixing import Mix

    m = Mix(docs, block=32, shard_slots=64)
    per = {}
    for r in m.slots().collect():
        per.setdefault((r.source, r.slot), []).append(r)
    assert m.shards > 1 and all(sum(x.words for x in v) <= 32 and len({x.shard for x in v}) == 1 for v in per.values())
    assert sum(sum(x.words for x in v) == 32 for v in per.values()) > 0.9 * len(per)


def test_permutation_is_one():
    import numpy as np

    from strayfield.llm.mixing import permuted

    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))


# 10 -----------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls(spark, broadcast):
    from strayfield.llm.url_filter import judge_urls

    rules = spark.createDataFrame([*queries.URL_RULES, ("bare.example", "block"), (None, "block"), ("", "block")], "rule string, verdict string")
    urls = {
        "HTTP://WWW.Example.COM/en/7x?a#b": ("www.example.com", "/en/7x", "example.com/en/7", "allow"), "x://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"), "x://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "x://a.net/de/": ("a.net", "/de/", "net/de/", "allow"), "x://example.net/de/8/": ("example.net", "/de/8/", "example.net/de/8", "block"), "x://a.org/ES/": ("a.org", "/ES/", None, "allow"), "x://org/es/1": ("org", "/es/1", "org/es/", "block"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://h?q=x://com/en/": ("h", "", None, "allow"), "x://s.bare.example": ("s.bare.example", "", "bare.example", "block"), "x:///en/": ("", "/en/", None, "allow"), "a\nb://é.com/en/\n": ("é.com", "/en/\n", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, next(iter(urls)), "x")], "page_id bigint, url string, host string")
    got = judge_urls(pages, rules, broadcast_rules=broadcast).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[list(urls)[r.page_id]]
    assert judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_blocks_of_a_bucket_meet_like_all_its_pairs(spark):
    """Members of large buckets dealt into small blocks give the pairs that comparing every two members gives."""
    from strayfield.llm.neardup import worth_confirming

    draw = random.Random(5)
    base = [draw.getrandbits(63) for _ in range(16)]
    members, sides = [], 10
    about = {}
    for node in range(60):
        bits = list(base)
        for _ in range(draw.choice([20, 60, 110])):
            bits[draw.randrange(16)] ^= 1 << draw.randrange(62)
        about[node] = (draw.randrange(6), draw.randrange(80, 120), [draw.randrange(3) for _ in range(2 * sides)], bits)
    for key in (3 * 128 + 0, 5 * 128 + 27, -7 * 128 + 99):
        own = [v for v in about if draw.random() < 0.8]
        members += [(key, v, about[v][0], len(own), *about[v][1:]) for v in own]
    side = spark.createDataFrame(members, "key long, node long, of long, _c long, n long, _half array<int>, _bits array<long>")

    most = int(1024 - (1024 * 0.9 - 4 * (1024 * 0.9 * 0.1) ** 0.5))
    expected = set()
    for key, a, of, _, n, half, bits in members:
        row, col = divmod(key & 127, sides)
        for key2, b, of2, _, n2, half2, bits2 in members:
            if key == key2 and a < b and of != of2 and min(n, n2) * 100 >= max(n, n2) * 80:
                apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits, bits2))
                before = any(half[k] == half2[k] for k in range(row)) or any(half[sides + k] == half2[sides + k] for k in range(col))
                if apart <= most and not before:
                    expected.add((a, b))
    assert len(expected) > 50
    for block in (3, 16, 1024):
        assert {tuple(r) for r in worth_confirming(side, 1024, sides, 80, block).collect()} == expected
    assert worth_confirming(side.limit(0), 1024, sides, 80).count() == 0


def test_more_tables_than_a_key_can_number_are_refused(spark):
    from strayfield.llm.neardup import near_duplicates

    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="sides"):
        near_duplicates(docs, sides=12)
