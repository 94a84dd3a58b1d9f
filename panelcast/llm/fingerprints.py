"""Document fingerprints: a homomorphic multiset hash over paragraph pieces.

A text is cut after line breaks and sentence marks.  Every piece is hashed (SHA-256 of its text, then 64 bits of that digest
under each of several seeds) to a wide vector and the vectors are summed, so the fingerprint does not depend on the order of the
pieces, and pieces can be added to or taken from a fingerprint without the rest of the text.  Two groups of lanes:

* ``sums``: 16 lanes of 32 bits from 8 seeds, summed modulo 2**32.  Equal multisets of pieces have equal sums.  Different pieces
  have vectors of their own as far as SHA-256 tells them apart, and different multisets meet by chance with about 2**-512 (the
  seeded 64-bit hash is not a cryptographic one, so nothing is claimed against texts made to collide).
* ``lanes``: 124 lanes of one bit (counted, modulo 2**31).  Read as +1 / -1 they form a random projection of the
  multiset: the squared length of the difference of two vectors estimates the number of pieces that only one side has.

Everything is DataFrame expressions; a text is hashed inside its row, without a shuffle.

The report pairs every document with the next one in descending id order.  Documents are dealt to ranges of ids that hold about
as many rows each (borders from quantiles); an id, or null, with more rows than that has several ranges, ordered by a hash of
the text.  The first row of each range also goes to the range before it, so one shuffle (by range) gives every row its neighbour.

Defined results: a null text is empty; an empty text has no pieces and all lanes 0; two empty texts have likeness 1,
an empty and another text 0; a null id comes last in the order, equal ids are ordered by a hash of the text; repeated
rows are each other's neighbours; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, let

MARKS = ".!?|;。！？"
#: A piece: what stands before a mark or line break, and the marks and white space that follow.
PIECE = rf"[^{MARKS}\n]++(?:[{MARKS}\n][{MARKS}\s]*+)?+|[{MARKS}\n][{MARKS}\s]*+"
SUM_HASHES = 8
BIT_HASHES = 2
BITS = 31
MOD32 = (1 << 32) - 1
PAIR = 1 | (1 << BITS)
RANGE_ROWS, MAX_RANGES = 2048, 10_000


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def fingerprint(text: Column) -> Column:
    """struct<n, sums array<bigint>, lanes array<bigint>> of a text (not null)."""
    zero = F.lit(0).cast("bigint")

    def lanes_of(hashes: Column, which: int) -> Column:
        # Two lanes (bits j and j + 31 of the hash) share one sum; each stays below 2**31.
        own = F.transform(hashes, lambda h: F.xxhash64(F.lit(which), h))
        return let(own, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.aggregate(
            hs, zero, lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(PAIR)))))

    def build(hashes: Column) -> Column:
        packed = F.concat(*[lanes_of(hashes, w) for w in range(BIT_HASHES)])
        lanes = F.flatten(F.transform(packed, lambda p: F.array(
            p.bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftright(p, BITS))))
        # One 64-bit hash feeds two 32-bit lanes.
        sums = F.flatten(F.transform(F.sequence(F.lit(BIT_HASHES), F.lit(BIT_HASHES + SUM_HASHES - 1)), lambda k: let(
            F.transform(hashes, lambda h: F.xxhash64(k, h)), lambda hs: F.array(
                F.aggregate(hs, zero, lambda a, h: (a + h.bitwiseAND(F.lit(MOD32))).bitwiseAND(F.lit(MOD32))),
                F.aggregate(hs, zero, lambda a, h: (a + F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(MOD32)))))))
        return F.struct(F.size(hashes).cast("bigint").alias("n"), sums.alias("sums"), lanes.alias("lanes"))

    return let(F.transform(pieces(text), lambda u: F.sha2(u, 256)), build)


def as_text(fp: Column) -> Column:
    """The fingerprint as a string: number of pieces, sums, lanes (hexadecimal, points between lanes)."""
    return F.concat_ws(":", fp["n"].cast("string"),
                       F.array_join(F.transform(fp["sums"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
                       F.array_join(F.transform(fp["lanes"], lambda x: F.lower(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of pieces in common, 0 to 1: 1 - |a - b|^2 / (|a|^2 + |b|^2) over the signed lanes."""
    def square(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)

    signed = lambda f: F.transform(f["lanes"], lambda c: (2 * c - f["n"]).cast("double"))
    return F.when((a["n"] == b["n"]) & (a["sums"] == b["sums"]), F.lit(1.0)).otherwise(
        let(F.struct(signed(a).alias("a"), signed(b).alias("b")), lambda v: let(
            square(v["a"]) + square(v["b"]), lambda both: F.when(both <= 0, F.lit(0.0)).otherwise(F.greatest(
                F.lit(0.0), 1 - square(F.zip_with(v["a"], v["b"], lambda x, y: x - y)) / both)))))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's pieces with b's added (sign 1) or taken away (sign -1)."""
    add = lambda x, y, mod: F.zip_with(x, y, lambda p, q: (p + sign * q).bitwiseAND(F.lit(mod)))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), add(a["sums"], b["sums"], MOD32).alias("sums"),
                    add(a["lanes"], b["lanes"], (1 << BITS) - 1).alias("lanes"))


def _range_of(borders: list[int], without: int):
    """The range of an id and tie, as an expression: ranges descend as ids descend (null last) and ties ascend.

    Range k holds the ids above border k - 1 up to border k.  An id that is several borders has as many ranges, a null ``without``
    ranges below 0.  Borders are searched by halving.
    """
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<decimal(20,0)>") if borders else None
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))]) if borders else None

    def below(id_: Column, or_equal: bool) -> Column:
        if table is None:
            return F.lit(0)
        passed = lambda b: b <= id_ if or_equal else b < id_
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
            F.coalesce(passed(F.get(table, low + step - 1)), F.lit(False)), low + step).otherwise(low))

    def at(id_: Column, tie: Column) -> Column:
        share = tie / F.lit(2.0 ** 64) + F.lit(0.5)
        own = lambda n: F.least(F.floor(share * n), n - 1)
        several = let(F.struct(below(id_, False).alias("first"), below(id_, True).alias("last")), lambda x: let(
            F.greatest(x["last"] - x["first"], F.lit(1)), lambda n: x["first"] + n - 1 - own(n)))
        return F.when(id_.isNull(), F.lit(-1) - own(F.lit(without))).otherwise(several).cast("bigint")
    return at


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    keys = docs.select(F.col(id_col).cast("decimal(20,0)").alias("id"))
    n, known = keys.agg(F.count(F.lit(1)), F.count("id")).first()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    borders = [] if ranges == 1 else keys.agg(F.percentile_approx(
        "id", [k / ranges for k in range(1, ranges)], F.lit(100 * ranges))).first()[0] or []
    at = _range_of([int(x) for x in borders], max(1, math.ceil(ranges * (n - known) / max(n, 1))))

    # A row for each range (MAX_RANGES for ids and as many for nulls at most): its first row, and the range before it.
    rows = docs.select(F.col(id_col).alias("doc"), F.col(id_col).cast("decimal(20,0)").alias("id"), filled(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumns({"range": at(F.col("id"), F.col("tie")), "place": F.struct(
        F.col("id").isNull().alias("none"), (-F.col("id")).alias("back"), F.col("tie").alias("tie"))})
    firsts = rows.groupBy("range").agg(F.min("place").alias("first"))
    down = Window.orderBy(F.col("range").desc())
    firsts = firsts.select("range", "first", F.coalesce(
        F.lag("range").over(down), F.min("range").over(Window.partitionBy())).alias("goes_to"))
    rows = rows.join(F.broadcast(firsts), "range")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("goes_to").alias("range"), F.lit(True).alias("guest"))
    rows = rows.select("doc", "id", "text", "tie", F.explode(
        F.when(F.col("place").eqNullSafe(F.col("first")), F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc", "id", "text", "tie", "at.range", "at.guest")

    order = Window.partitionBy("range").orderBy("guest", F.col("id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("doc", "id", "tie", "range", "guest", "text", edited.alias("edited"))
    rows = rows.select(
        "doc", "id", "tie", "range", "guest", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"),
        F.when(~F.col("guest"), fingerprint(F.col("edited"))).alias("edited_fp"))
    rows = rows.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("guest"))
    return rows.select(
        F.col("doc").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
