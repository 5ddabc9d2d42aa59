"""PII by patterns, and information-theoretic sanitisation of the terms that give it away.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers) and their classes (an address's domain, a
network, an issuer, an area). Over all distinct texts, words that stand near an entity or class are counted with it, and by themselves. A
word discloses an entity if, by a lower confidence bound, the entity is more likely than not given the word, and the word tells many bits
about it (pointwise mutual information); so does a rare name that stands in one text alone, beside an address. Disclosing words are generalised like the entities themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted

RUN, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Leftmost matches can only begin where a run begins, or behind the last match; possessive loops then need no second try.
PATTERNS = {
    "email": rf"(?:\G|(?<!{RUN})){RUN}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have before its pattern is tried.
FIRST = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KINDS = (*PATTERNS, "term")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total, i):
        d = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return c.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        n = digits(c)
        return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(c)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """The valid matches of one kind, with their places in code points."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    none = F.array().cast(SPAN)

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(valid(kind, x["value"]), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    steps = F.transform(found, lambda v, i: F.struct(F.char_length(F.get(between, i)).alias("gap"), v.alias("value")))
    placed = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(FIRST[kind]), placed).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``_spans``: all matches by start, then kind. ``text`` is made a non-null string."""
    d = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    every = F.array_sort(F.concat(*[spans_of(F.col("text"), k) for k in PATTERNS]))
    return d.withColumn("_spans", F.when(F.col("text").rlike("[0-9@]"), every).otherwise(F.array().cast(SPAN)))


@dataclass(frozen=True)
class Disclosure:
    """When a word discloses an entity: how likely the entity is in a text with the word, at least, by Wilson's lower bound of
    ``deviations`` standard errors, and how many bits the word tells about it. By the defaults one text suffices if the word stands in no
    other; of four texts with the word three must have the entity beside it. ``posterior`` above 0.5 asks for two texts at least."""

    posterior: float = 0.5
    deviations: float = 1.0
    bits: float = 4.0
    reach: int = 8
    shortest: int = 3


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


#: Words between two marks of a text's word index.
STRIDE = 256


def indexed(d: DataFrame) -> DataFrame:
    """Add ``_words``, the words of ``text``; ``_steps``, from each word's start to the next one's in code points; ``_marks``, the start of
    every 256th word. A word's place, or the word at a place, is then found by a mark and the steps behind it."""
    d = d.withColumns({"_words": F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), "_gaps": F.split("text", TERM, -1)})
    d = d.withColumn("_steps", F.zip_with("_words", F.slice("_gaps", 2, F.size("_words")), lambda w, g: F.char_length(w) + F.char_length(g)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size("_words") / STRIDE).cast("int")), lambda c: F.aggregate(F.slice("_steps", c * STRIDE + 1, STRIDE), F.lit(0), lambda a, x: a + x))
    first = F.array(F.char_length(F.get("_gaps", 0)))
    marks = F.aggregate(chunks, first, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return d.withColumn("_marks", marks).drop("_gaps")


def start_of(i: Column) -> Column:
    """Where the i-th word begins."""
    chunk = F.floor(i / STRIDE).cast("int")
    return F.get("_marks", chunk) + F.aggregate(F.slice("_steps", chunk * STRIDE + 1, i - chunk * STRIDE), F.lit(0), lambda a, x: a + x)


def words_before(place: Column) -> Column:
    """How many words begin before ``place``."""
    chunk = F.greatest(F.lit(0), F.size(F.filter("_marks", lambda m: m < place)) - 1)
    steps = F.slice("_steps", chunk * STRIDE + 1, STRIDE)
    begin = F.struct(F.get("_marks", chunk).alias("at"), F.lit(0).alias("n"))
    count = lambda a, x: F.struct((a["at"] + x).alias("at"), (a["n"] + (a["at"] < place).cast("int")).alias("n"))
    return chunk * STRIDE + F.aggregate(steps, begin, count, lambda a: a["n"])


def entities(span: Column) -> Column:
    """The protected value of a span, and the class it falls in."""
    value, number = F.lower(span["value"]), digits(span["value"])
    of_kind = {
        "email": (value, F.concat(F.lit("domain:"), F.substring_index(value, "@", -1))),
        "ip": (value, F.concat(F.lit("network:"), F.substring_index(value, ".", 2))),
        "card": (number, F.concat(F.lit("issuer:"), F.substring(number, 1, 6))),
        "phone": (number, F.concat(F.lit("area:"), F.substring(number, F.lit(1), F.length(number) - 7))),
    }
    chosen = F.lit(None).cast("array<string>")
    for kind, (own, group) in of_kind.items():
        chosen = F.when(span["kind"] == kind, F.array(F.concat(F.lit(kind + ":"), own), group)).otherwise(chosen)
    return chosen


def text_hash(text: Column) -> Column:
    """Copies of a text count once: 64 bits stand for it."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def neighbours(docs: DataFrame, rule: Disclosure) -> DataFrame:
    """(_text, entity, word), each once: the words within reach of each entity, and of its class, of whatever length they are. Words that lie in it,
    or partly, aren't. An entity without such words has a row with a null word."""
    d = base_spans(docs.select("text", text_hash(F.col("text")).alias("_text"))).where(F.size("_spans") > 0)
    d = indexed(d).select("_text", "_words", "_steps", "_marks", F.explode("_spans").alias("s"))
    d = d.withColumns({"_before": words_before(F.col("s.start")), "_upto": words_before(F.col("s.end"))})
    last = F.greatest(F.lit(0), F.col("_before") - 1)
    inside = (F.col("_before") > 0) & (start_of(last) + F.char_length(F.get("_words", last)) > F.col("s.start"))
    d = d.withColumn("_before", F.col("_before") - inside.cast("int"))
    low = F.greatest(F.lit(0), F.col("_before") - rule.reach)
    lowered = lambda words: F.transform(words, lambda w: F.lower(w))
    left = lowered(F.slice("_words", low + 1, F.col("_before") - low))
    right = lowered(F.slice("_words", F.col("_upto") + 1, F.lit(rule.reach)))
    near = F.filter(F.array_distinct(F.concat(left, right)), lambda w: (F.length(w) >= rule.shortest) & ~w.rlike("^[0-9]+$"))
    d = d.select("_text", F.explode(entities(F.col("s"))).alias("entity"), near.alias("_near"))
    return d.select("_text", "entity", F.explode_outer("_near").alias("word")).distinct()


def lower_bound(k: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share of which ``k`` of ``n`` are seen. It falls as ``n`` grows."""
    return (k + z * z / 2 - z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def disclosing(docs: DataFrame, rule: Disclosure = Disclosure(), broadcast_words: int = 100_000) -> DataFrame:  # noqa: B008
    """(word, entity, posterior, bits) of the words that disclose an entity or a class, from counts over all distinct texts. ``posterior`` is the bound."""
    near = persisted(neighbours(docs, rule), "pii-near")
    # a word stands in at least as many texts as it stands in near any entity: what that alone rules out needn't be counted over all
    worded = near.where("word is not null")
    beside = worded.groupBy("word").agg(F.countDistinct("_text").alias("_beside"))
    pairs = worded.groupBy("entity", "word").agg(F.count("*").alias("both")).where(lower_bound(F.col("both"), F.col("both"), rule.deviations) >= rule.posterior)
    pairs = pairs.join(beside, "word").where(lower_bound(F.col("both"), F.col("_beside"), rule.deviations) >= rule.posterior)
    pairs = persisted(pairs.drop("_beside"), "pii-pairs")
    words = pairs.select("word").distinct()
    n_words = words.limit(broadcast_words + 1).count()
    if not n_words:
        return pairs.select("word", "entity", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("bits"))
    every = docs.select(text_hash(F.col("text")).alias("_text"), F.explode(F.array_distinct(words_of(F.col("text").cast("string")))).alias("word"))
    asked = F.broadcast(words) if n_words <= broadcast_words else words
    alone = every.join(asked, "word", "left_semi").distinct().groupBy("word").agg(F.count("*").alias("alone"))
    entity = near.groupBy("entity").agg(F.countDistinct("_text").alias("of_entity"))
    n = docs.select(text_hash(F.col("text")).alias("_text")).distinct().count()
    told = pairs.join(alone, "word").join(entity, "entity")
    bits = F.log2(F.col("both") * F.lit(float(n)) / (F.col("alone") * F.col("of_entity")))
    told = told.select("word", "entity", lower_bound(F.col("both"), F.col("alone"), rule.deviations).alias("posterior"), bits.alias("bits"))
    return told.where((F.col("posterior") >= rule.posterior) & (F.col("bits") >= rule.bits))


def protected(docs: DataFrame, rule: Disclosure = Disclosure(), block: int = 100_000, carry_text: bool = True) -> DataFrame:  # noqa: B008
    """``docs`` with ``_spans``: the pattern matches, and the disclosing words outside of them (kind ``term``).

    ``docs`` needs a text column only; its others are kept, and the text itself if ``carry_text``; a ``_spans`` of the caller is replaced.
    Disclosing words are broadcast in blocks of ``block``.
    """
    terms = persisted(disclosing(docs, rule).groupBy("word").agg(F.max("bits").alias("bits")), "pii-terms")
    n = terms.count()
    d = base_spans(docs)
    if not n:
        return d
    blocks = -(-n // block)
    kept = [c for c in d.columns if (carry_text or c != "text") and c != "_spans"]
    document = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]).alias("_doc")
    place = F.posexplode(F.concat(F.array(F.lit("")), F.transform("_words", lambda w: F.lower(w)))).alias("_i", "_word")
    # _i is 0 for the document itself, which every document has, else a word's number, from 1 on
    d = indexed(d.select(document, "text", "_spans", F.monotonically_increasing_id().alias("_row"))).select("_row", "_doc", "_spans", "_words", "_steps", "_marks", place)
    hit = F.lit(False)
    for k in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).select(F.col("word").alias("_word"), F.lit(True).alias(f"_found{k}"))
        d = d.join(F.broadcast(own), "_word", "left")
        hit = hit | F.col(f"_found{k}").isNotNull()
    d = d.withColumn("_hit", hit).where("_hit or _i = 0")
    start, own = start_of(F.col("_i") - 1), F.get("_words", F.col("_i") - 1)
    term = F.struct(start.alias("start"), F.lit(len(KINDS) - 1).alias("rank"), F.lit("term").alias("kind"), (start + F.char_length(own)).alias("end"), own.alias("value"))
    whole = lambda c: F.when(F.col("_i") == 0, F.col(c)).alias(c)
    d = d.select("_row", whole("_doc"), whole("_spans"), F.when(F.col("_hit"), term).alias("_term"))
    d = d.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_doc", "_spans")], F.collect_list("_term").alias("_terms"))
    free = F.filter("_terms", lambda t: ~F.exists("_spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return d.select(*[F.col(f"_doc.c{k}").alias(c) for k, c in enumerate(kept)], F.array_sort(F.concat("_spans", free)).alias("_spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """One row (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) per row of ``docs``.

    Places are in code points, the end exclusive. A null text is empty; without matches the list is empty. Repeated rows give repeated
    results (as copies, they add no context to the counts); an empty table gives an empty result; other columns are ignored.
    """
    d = protected(docs.select("doc_id", "text"), rule, carry_text=False)
    base = F.filter("_spans", lambda s: s["kind"] != "term")
    n = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *[n(k) for k in PATTERNS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"), n("term"))


def sanitised(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """``docs`` with every span of ``text`` generalised to its kind, like ``[EMAIL]``.

    A null text stays null, an empty one empty; overlapping spans become one. Repeated rows stay repeated; an empty table gives an empty
    one; other columns, whatever their names, are kept as they are.
    """
    own = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("_null")).alias("_own")
    d = protected(docs.select(own, "text"), rule)

    def step(a, s):
        here = s["start"] >= a["at"]
        out = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(here, out).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    rest = lambda a: F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), F.char_length("text") - a["at"]))
    end = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], rest(a)))
    text = F.when(F.col("_own._null"), F.lit(None).cast("string")).when(F.size("_spans") == 0, F.col("text")).otherwise(end)
    return d.select(*[text.alias(c) if c == "text" else F.col(f"_own.c{k}").alias(c) for k, c in enumerate(docs.columns)])
