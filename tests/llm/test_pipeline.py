"""The stages of the corpus pipeline on planted rows."""

import random
import string

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline

SF = f"{DATA}/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)


def test_language_stage_rejects_what_it_never_learned(spark, docs):
    rng = random.Random(3)
    letters = lambda n: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n))
    strange = [
        letters(100), letters(10), "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(800)),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "所有人生而自由，在尊严和权利上一律平等。",
        "for i, row in enumerate(rows):\n    if row.key not in seen:\n        seen[row.key] = i\n", "", "12 34 %%%", None,
    ]
    planted = spark.createDataFrame([(10**9 + k, t, None, "planted", len(t or "")) for k, t in enumerate(strange)], DOC)
    got = corpus_pipeline.language(spark, docs.unionByName(planted), SF).cache()
    assert got.where("source = 'planted'").count() == 0
    # clean documents stay, each with its own language
    assert got.count() == docs.where("text rlike '[A-Za-z]'").count()
    assert got.join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").where("lang <> own").count() <= 0.01 * docs.count()


def test_language_stage_of_empty_tables(spark, docs):
    assert corpus_pipeline.language(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0


def test_familiar_trigrams_and_shares_come_from_all_labelled_rows(spark):
    """A replay over all rows: words of one text in five hundred are familiar, a word of one text alone isn't."""
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from strayfield.llm import language_id as li

    code = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    base = {"en": "the cat and the dog went out", "de": "der hund und die katze gingen"}
    made = [(i, f"{base[lang]} {code(7919 * (i % 500))} {code(104_729 * i)}", lang) for i in range(12_000) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame([*made, (-1, None, "en"), (-2, "no language", None)], "doc_id bigint, text string, lang string")
    model = li.learned(docs)
    known = li.familiar(docs, model)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts, n = defaultdict(Counter), Counter()
    for i, text, lang in made:
        if not held(i):
            texts[lang].update({int(x) >> (32 - li.BITS) for x in li.trigrams(text)})
            n[lang] += 1
    for lang, table in known.tables().items():
        want = {at for at, c in texts[lang].items() if c * li.ONE_IN >= n[lang]}
        assert set(np.flatnonzero(table)) == want and len(want) < len(texts[lang])
        own = [(text, got) for (i, text, v) in made if held(i) and v == lang for ((got, _),) in [model.predict(li.features(text)[None])] if got == lang]
        shares = np.array([known.share(text, table) for text, _ in own])
        assert known.least[lang] == li.SLACK * max(s for s in range(li.STEPS + 1) if 100 * (np.floor(li.STEPS * shares) < s).sum() <= len(shares)) / li.STEPS
    assert sorted(known.least) == ["de", "en"]
