"""Personal data: pattern spans, and terms of the corpus that give a protected value away.

Four kinds of values are found by pattern (e-mail address, IP address, card number, phone number).  Each distinct
value is a protected entity e.  A term t that stands in a document with e, at any distance and also inside e, is judged by
what it tells about e, estimated from whole documents:  PMI(e; t) = log(N n(e, t) / (n(e) n(t))),  against the
information content IC(e) = log(N / n(e)).  At PMI = IC the term never occurs without e and reveals it fully.  In all documents, with e or without it, terms with
PMI >= REMOVE * IC are removed and those with PMI >= GENERALISE * IC are generalised (to the shape of the word).
Evidence must come from at least CONTEXTS documents with different surroundings of e (the NEAR_WORDS words on each side),
so copies of one passage prove nothing.  The surroundings tell copies apart; they do not limit which terms are judged.

All counts run over all documents.  Everything is DataFrame expressions: values and places come from splitting a text at
its matches, Luhn sums and running lengths from array functions.  Patterns are written so that they never back up
over what they have read (possessive), which keeps them linear and off the stack on very long runs.

Defined results: a null text is empty; rows that repeat id and text count each as a document, and as one surrounding,
and each get their spans; ids may be null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_ROWS, filled, let, running_sums, small_enough, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REMOVE, GENERALISE = 1.0, 0.9
CONTEXTS = 2
NEAR_WORDS, NEAR_CHARS = 8, 120

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Each finds the same leftmost, non-overlapping matches as the plain pattern of its kind (card: those of 14 digits or more).
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){14})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text needs to be worth the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
WORD_BREAK = r"[^\p{L}\p{N}]+"


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points, end exclusive."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("rest"))
    return let(found, lambda m: let(
        F.struct(m["value"].alias("value"), lengths(m["value"]).alias("size"), lengths(m["rest"]).alias("gap")),
        lambda x: let(running_sums(F.transform(x["value"], lambda _, i: F.get(x["gap"], i) + F.get(x["size"], i))),
                      lambda before: F.transform(x["value"], lambda v, i: F.struct(
                          (F.get(before, i) + F.get(x["gap"], i)).alias("start"),
                          (F.get(before, i) + F.get(x["gap"], i) + F.get(x["size"], i)).alias("end"), v.alias("value"))))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def share(place: Column) -> Column:  # the place counts from the right, from 0
        d = F.substring(number, F.length(number) - place, F.lit(1)).cast("int") * F.when(place % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + share(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (
            F.when(F.length(q) <= 3, q).otherwise("999").cast("int") <= 255))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the pattern kinds, ordered; ``kind`` is the place in KINDS."""
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, value: string>>")

    def of(k: int, kind: str) -> Column:
        found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: valid(kind, m["value"]))
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"),
                                                      m["value"].alias("value")))
        return F.when(text.rlike(HINTS[kind]), found).otherwise(none)

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _near(text: Column, span: Column) -> Column:
    """The words next to a span, NEAR_WORDS on each side (of at most NEAR_CHARS characters; cut words are left out)."""
    at = F.greatest(span["start"] - NEAR_CHARS, F.lit(0))
    left = F.substring(text, (at + 1).cast("int"), (span["start"] - at).cast("int"))
    left = F.when(at > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.substring(text, (span["end"] + 1).cast("int"), F.lit(NEAR_CHARS))
    right = F.when(F.length(right) == NEAR_CHARS, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    return F.concat(let(_words(left), lambda w: F.slice(w, F.greatest(F.size(w) - NEAR_WORDS, F.lit(0)) + 1, F.lit(NEAR_WORDS))),
                    F.slice(_words(right), 1, NEAR_WORDS))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and mark (which with the id stands for the document)."""
    return docs.select(F.col(id_col).alias("id"), filled(text_col).alias("text")) \
        .withColumn("mark", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """words (the distinct ones of the text) and values array<struct<kind, value, context>>: a row for each document with values.

    A value that stands in several places of a document is listed once; its context is the hash of the words around all of them.
    """
    rows = docs.select(filled(text_col).alias("text")).where(F.col("text").rlike("@|[0-9]"))
    rows = rows.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)

    def listed(e: Column) -> Column:
        own = F.filter("spans", lambda s: (s["kind"] == e["kind"]) & (s["value"] == e["value"]))
        near = F.array_distinct(F.flatten(F.transform(own, lambda s: _near(F.col("text"), s))))
        return F.struct(e["kind"].alias("kind"), e["value"].alias("value"), F.xxhash64(F.array_sort(near)).alias("context"))

    distinct = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    return rows.select(F.array_distinct(_words(F.col("text"))).alias("words"), F.transform(distinct, listed).alias("values"))


def _contexts() -> Column:
    """Different contexts of a group, counted as far as two (CONTEXTS): that adds up per task before the shuffle."""
    return F.size(F.array_distinct(F.array(F.min("context"), F.max("context"))))


def revealing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, value, term, strength (PMI / IC) of the terms at or above the lower threshold; found has the mentions."""
    held = found.select(F.explode("values").alias("e"), "words").select("e.*", "words")
    values = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("with_value"), _contexts().alias("contexts"))
    values = cut_lineage(values.where(F.col("contexts") >= CONTEXTS).drop("contexts"))
    # The others have no term with enough contexts.  Pairs are counted per task first, so a value that very many documents hold
    # sends a row per term and task.
    pairs = held.join(small_enough(values.select("kind", "value")), ["kind", "value"], "left_semi")
    pairs = pairs.select("kind", "value", "context", F.explode("words").alias("term")).groupBy("kind", "value", "term").agg(
        F.count(F.lit(1)).alias("both"), _contexts().alias("contexts"))
    pairs = stored(pairs.where(F.col("contexts") >= CONTEXTS).drop("contexts"))

    # Documents with a term: each document names its terms once, so counting before the shuffle leaves a row per term and task.
    terms = cut_lineage(pairs.select("term").distinct())
    everywhere = docs.select(F.explode(F.array_distinct(_words(filled(text_col)))).alias("term"))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        everywhere = everywhere.join(F.broadcast(terms), "term")
    with_term = everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    n = float(max(docs.count(), 1))
    scored = pairs.join(small_enough(values), ["kind", "value"]).join(with_term, "term")
    pmi = F.log(F.lit(n) * F.col("both") / (F.col("with_value") * F.col("with_term")))
    content = F.log(F.lit(n) / F.col("with_value"))
    scored = scored.withColumn("strength", F.when(content > 0, pmi / content).otherwise(F.lit(0.0)))
    return scored.where(F.col("strength") >= GENERALISE - 1e-9).select("kind", "value", "term", "strength")


def terms_of_documents(docs: DataFrame, revealing: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """mark, terms array<struct<term, strength>>: what to hide in each document, whether it contains the protected value or not."""
    strongest = cut_lineage(revealing.groupBy("term").agg(F.max("strength").alias("strength")))
    words = _rows(docs, id_col, text_col).select("mark", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    hits = words.join(small_enough(strongest), "term").groupBy("mark", "term").agg(F.max("strength").alias("strength"))
    return hits.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("term", "strength"))).alias("terms"))


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, base, hidden``: pattern spans, and the spans of revealing terms that lie outside them."""
    found = stored(mentions(docs, text_col))
    terms = cut_lineage(terms_of_documents(docs, revealing_terms(docs, found, text_col), id_col, text_col))
    rows = _rows(docs, id_col, text_col).withColumn("base", base_spans(F.col("text")))
    rows = rows.join(small_enough(terms), "mark", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"),
                       F.lit(r")(?![\p{L}\p{N}])"))
    places = F.transform(matches(F.col("text"), pattern), lambda m: F.struct(
        m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    outside = F.filter(places, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, value: string>>")
    return rows.select("id", "text", "base", F.when(F.col("terms").isNotNull(), outside).otherwise(none).alias("hidden"), "terms")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = all_spans(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select(
        F.col("id").alias(id_col), *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "hidden"))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "sanitised") -> DataFrame:
    """id and the text with pattern values replaced by their kind, revealing terms removed or generalised to their shape."""
    rows = all_spans(docs, id_col, text_col)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    shape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "X"), r"[\p{L}&&[^X]]", "x"), r"\p{N}", "0")

    def instead(s: Column) -> Column:
        strong = F.exists("terms", lambda t: (t["term"] == F.lower(s["value"])) & (t["strength"] >= REMOVE - 1e-9))
        return F.when(s["kind"] < len(KINDS), F.element_at(labels, F.least(s["kind"], F.lit(len(KINDS) - 1)) + 1)) \
            .when(strong, F.lit("")).otherwise(shape(s["value"]))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    done = F.aggregate(F.sort_array(F.concat("base", "hidden")), start, lambda a, s: F.when(s["start"] < a["at"], F.struct(
        F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                                           instead(s)).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return rows.select(F.col("id").alias(id_col), done.alias(out_col))
