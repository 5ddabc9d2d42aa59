"""Language ID by hierarchical discrimination.

Hashed counts of letter trigrams (of UTF-8 bytes) are the features. Linear support vector machines, one
for each pair, first choose the language family; then one-versus-one machines separate the
languages inside it. They are fitted on a bounded sample of labelled rows; features are
extracted where the texts are, so the driver sees vectors of a fixed width only.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

WIDTH = 4096
#: Bits of a trigram's number in the tables of familiar trigrams, and the trigrams of good will that each text has
#: besides its own, so that a few words aren't judged by one name in them.
BITS, GOODWILL = 20, 10
#: Fixed value: a trigram is familiar if at least one in so many labelled texts of its language has it, so that an odd text among
#: many doesn't make its own trigrams familiar.
ONE_IN = 1000
#: Of the familiar share that one in a hundred held-out rows of a language doesn't reach, the part that a text must have; the least share
#: where a language has no held-out rows; and the steps in which shares are counted.
SLACK, LEAST_KNOWN, STEPS = 0.75, 0.6, 10_000
#: Families of ISO 639-1 codes. A language that isn't named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "semitic": "ar he am mt",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "indic": "hi ur bn pa mr gu ne",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters stay, all else becomes a space.
BYTE = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def family(lang: str) -> str:
    return FAMILY.get(lang, lang)


def trigrams(text: str) -> np.ndarray:
    """The 32-bit hashes of the letter trigrams, in order."""
    b = BYTE[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return code[(b[1:-1] != 32)] * np.uint32(2654435761)


def features(text: str) -> np.ndarray:
    x = np.bincount(trigrams(text) >> np.uint32(20), minlength=WIDTH).astype(np.float32)
    x = np.sqrt(x)
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, decay: float = 1e-4, seed: int = 5) -> np.ndarray:
    """A linear machine of y (1, -1) by averaged stochastic subgradients of the hinge loss; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, mean, order = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.random.default_rng(seed)
    t = 1
    for r in range(rounds):
        for i in order.permutation(len(x)):
            rate = 1 / (decay * (t + 1000))
            margin = y[i] * (x[i] @ w)
            w *= 1 - rate * decay
            if margin < 1:
                w += rate * 0.01 * weight[i] * y[i] * x[i]
            t += 1
        if r >= rounds // 2:
            mean += w
    return (mean / (rounds - rounds // 2)).astype(np.float32)


class Hierarchy:
    """Pairwise machines of the families and of the languages within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        own = np.array(langs)
        kin = np.array([family(v) for v in langs])
        self.families = {f: sorted(set(own[kin == f])) for f in sorted(set(kin))}
        self.levels = {None: self.pairs(x, kin, list(self.families))}
        for f, members in self.families.items():
            self.levels[f] = self.pairs(x, own, members)

    @staticmethod
    def pairs(x, labels, classes):
        out = []
        for a, b in combinations(classes, 2):
            at = (labels == a) | (labels == b)
            out.append((a, b, svm(x[at], np.where(labels[at] == a, 1, -1))))
        return classes, out

    @staticmethod
    def choose(x: np.ndarray, level) -> list[tuple[str, float]]:
        """(class, score from 0 to 1) of each row: most of the pairwise probabilities."""
        classes, machines = level
        p = np.zeros((len(x), len(classes)))
        for a, b, w in machines:
            q = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -30, 30)))
            p[:, classes.index(a)] += q
            p[:, classes.index(b)] += 1 - q
        p = p / (len(classes) - 1) if machines else np.ones_like(p)
        return [(classes[k], float(v)) for k, v in zip(p.argmax(1), p.max(1), strict=True)]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        first = self.choose(x, self.levels[None])
        out = [None] * len(x)
        for f in self.families:
            at = [i for i, (g, _) in enumerate(first) if g == f]
            if at:
                for i, (lang, score) in zip(at, self.choose(x[at], self.levels[f]), strict=True):
                    out[i] = (lang, score * first[i][1])
        return out


def sample(rows: DataFrame, per_lang: int) -> tuple[DataFrame, int]:
    """About ``per_lang`` rows (lang, text) of each language of ``rows`` (doc_id, text, lang), picked by a hash of the id; and how many languages."""
    rows = rows.where("lang is not null and text is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * per_lang / v))) for k, v in sorted(n.items())]) if n else F.lit(0.0)
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text"), len(n)


def fit(rows: DataFrame, per_lang: int = 400) -> Hierarchy | None:
    """Fit on about ``per_lang`` rows of each language of ``rows`` (doc_id, text, lang): a hash of the id picks them."""
    picked, n = sample(rows, per_lang)
    if not n:
        return None

    def vectors(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                x = [features(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])

    found = picked.mapInArrow(vectors, "lang string, x binary").limit(8 * per_lang * n).collect()
    found.sort(key=lambda r: (r.lang, bytes(r.x)))
    if not found:
        return None
    return Hierarchy(np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in found]), [r.lang for r in found])


class Familiar:
    """Which trigrams were seen in each language, and how large a share of a text's trigrams must be among those of its language."""

    def __init__(self, seen: dict[str, np.ndarray]):
        tables = {k: np.zeros(1 << BITS, bool) for k in seen}
        for k, v in seen.items():
            tables[k][v] = True
        self.packed = {k: np.packbits(v) for k, v in tables.items()}
        self.least: dict[str, float] = {}

    def tables(self) -> dict[str, np.ndarray]:
        return {k: np.unpackbits(v).view(bool) for k, v in self.packed.items()}

    @staticmethod
    def share(text: str, table: np.ndarray) -> float:
        at = trigrams(text) >> np.uint32(32 - BITS)
        return (int(table[at].sum()) + GOODWILL) / (len(at) + GOODWILL)


def familiar(docs: DataFrame, model: Hierarchy | None) -> Familiar | None:
    """The familiar trigrams of each language and the least shares, from all labelled rows: the trigrams from those that aren't held out, the shares
    from those that are.

    Tasks count the texts that have a trigram, and the held-out rows of each step of the share; Spark sums both. The driver sees the
    familiar trigrams and at most ``STEPS`` + 1 counts of each language, however many rows there are.
    """
    if model is None:
        return None
    rows = labelled(docs).where("lang is not null and text is not null")
    learnt = rows.where(~held_out())

    def counted(batches):
        found: dict[str, np.ndarray] = {}

        def emit():
            for lang, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in found:
                    if len(found) == 16:  # tables of four megabytes each
                        yield from emit()
                    found[lang] = np.zeros(1 << BITS, np.uint32)
                found[lang][np.unique(trigrams(text) >> np.uint32(32 - BITS))] += 1
        yield from emit()

    texts = learnt.groupBy("lang").agg(F.count("*").alias("texts"))
    seen = learnt.select("lang", "text").mapInArrow(counted, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    often = seen.join(F.broadcast(texts), "lang").where(F.col("n") * ONE_IN >= F.col("texts")).select("lang", "at").toArrow()
    langs, at = np.array(often["lang"].to_pylist(), object), often["at"].to_numpy()
    known = Familiar({k: at[langs == k] for k in sorted({r.lang for r in texts.collect()})})

    def shares(batches):
        tables = known.tables()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part.column("text").to_pylist()
                guess = model.predict(np.stack([features(t) for t in texts]))
                got = [(g, int(STEPS * known.share(t, tables[g]))) for (g, _), t, lang in zip(guess, texts, part.column("lang").to_pylist(), strict=True) if g == lang and LETTER.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array([x for _, x in got], pa.int32())], names=["lang", "step"])

    clean: dict[str, list[tuple[int, int]]] = {}
    for r in rows.where(held_out()).select("lang", "text").mapInArrow(shares, "lang string, step int").groupBy("lang", "step").agg(F.count("*").alias("n")).collect():
        clean.setdefault(r.lang, []).append((r.step, r.n))
    known.least = {k: SLACK * hundredth(clean[k]) / STEPS if k in clean else LEAST_KNOWN for k in known.packed}
    return known


def hundredth(counts: list[tuple[int, int]]) -> int:
    """The greatest step that at most one in a hundred of the counted (step, n) lie below."""
    below, total = 0, sum(n for _, n in counts)
    for step, n in sorted(counts):
        below += n
        if 100 * below > total:
            return step
    raise ValueError("nothing counted")


def with_language(docs: DataFrame, model: Hierarchy | None, carry_text: bool = True, known: Familiar | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole column ``text`` alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there was nothing to learn from. Where ``known``
    is given, so is a text of which too small a share of trigrams was seen in the language found: machines that tell languages apart have
    a winner for any text.
    """

    def predict(batches):
        tables = known.tables() if known else {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part.column("text").to_pylist()
                at = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
                out = [("und", 0.0)] * len(texts)
                if at:
                    for i, got in zip(at, model.predict(np.stack([features(texts[i]) for i in at])), strict=True):
                        if known is None or known.share(texts[i], tables[got[0]]) >= known.least[got[0]]:
                            out[i] = got
                columns = [*zip(names, part.columns, strict=True), ("lang_pred", pa.array([x for x, _ in out], pa.string())), ("score", pa.array([x for _, x in out], pa.float64()))]
                yield pa.RecordBatch.from_arrays([c for n, c in columns if n in kept], names=[n for n, _ in columns if n in kept])

    names = docs.columns
    kept = [*(n for n in names if carry_text or n != "text"), "lang_pred", "score"]
    fields = {f.name: f for f in docs.schema}
    schema = ", ".join(f"`{n}` {fields[n].dataType.simpleString()}" if n in fields else f"{n} {'string' if n == 'lang_pred' else 'double'}" for n in kept)
    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) per row of ``docs``. Repeated rows give repeated results; an empty table gives an empty
    result; other columns are ignored."""
    return with_language(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model, carry_text=False)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def learned(docs: DataFrame, per_lang: int = 400) -> Hierarchy | None:
    """A model of the labelled rows of ``docs`` that aren't held out."""
    return fit(labelled(docs.where(~held_out())), per_lang)


def language_id(docs: DataFrame, per_lang: int = 400) -> DataFrame:
    """Learn from the rows that aren't held out, then identify all."""
    return identify(docs, learned(docs, per_lang))
