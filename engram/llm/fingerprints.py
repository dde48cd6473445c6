"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled.

A text is cut into paragraphs at line feeds, and a long paragraph every ``PIECE`` code points, so that one digest never
stands for much text. The distinct 64-bit digests go into ``TABLES`` x ``CELLS`` cells: each digest is added to one cell
of each table (count, xor of digests, xor of their hashes). The cells of two versions are subtracted, and peeling
recovers the digests that differ: a cell with a count of 1 or -1 whose hash fits holds one digest, which is taken out
of its other cells, and so on. If it gets stuck, the digests are dealt by two more of their bits into four sketches of
that size each (a table four times as large) and only those that fail again are enlarged further, ``GROWTHS`` times;
what is left after that (digests that agree in all cells) is compared directly.

Likeness is the Jaccard similarity that follows from both counts and the number of recovered digests. Everything is
built-in functions on one row. The next document comes in by a window over ranges of ids: rows of a range are sorted
within it, and a range also gets the first row of the next range, so no window spans the table, and texts are shuffled
once, with their digests. Ranges are cut at quantiles of the ids, in two steps (of all ids, then of each coarse range's),
so ids may lie anywhere; what is broadcast are these cuts, at most ``MOST_CUTS`` squared numbers (2 MB).

Defined cases: null text is empty; it has no digests, and two texts without digests have likeness 1. Rows are ordered by
id (null first), rows that repeat an id by text, repeated rows follow each other; rows of one id are in one range. A very
long text is one row: its digests take 8 bytes per ``PIECE`` code points, and a range of its own if it is longer than one.
A single row is its own next one. No rows give no rows. Only id and text are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import id_and_text, table

PIECE = 128
#: Tables of a sketch, and cells of each (a power of two).
TABLES, CELLS = 3, 8
ROUNDS, GROWTHS = 10, 8
#: Characters of a range on average, and cuts of each of the two steps.
RANGE_CHARS, MOST_CUTS = 400_000, 448
_FIRST = -(2**63)


def digests(text: Column, piece: int = PIECE) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text, in their order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{piece}}}\n?|\n"), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(key: Column, part: int) -> Column:
    """The cell of a digest in one of the tables: each table takes other bits of it."""
    return F.call_function("shiftrightunsigned", key, F.lit(20 * part)).bitwiseAND(F.lit(CELLS - 1).cast("long"))


def _cells() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _xor(keys: Column, of=lambda k: k) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(of(k)))


def sketch(keys: Column) -> Column:
    """Cells (n, key, check) of a set of digests."""

    def dealt(part: int) -> Column:
        return F.transform(_cells(), lambda i: F.filter(keys, lambda k: _place(k, part) == i))

    return F.transform(F.concat(*map(dealt, range(TABLES))), lambda own: F.struct(F.size(own).alias("n"), _xor(own).alias("key"), _xor(own, lambda k: F.xxhash64(k)).alias("check")))


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column) -> Column:
    """The digests of a subtracted sketch; null if it can't be peeled whole."""

    def empty(x: Column) -> Column:
        return ~F.exists(x, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["check"]))
        pure = F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))

        def without(cell: Column, i: Column, taken: Column, part: int) -> Column:
            out = lambda acc, p: F.struct((acc["n"] - p["n"]).alias("n"), acc["key"].bitwiseXOR(p["key"]).alias("key"), acc["check"].bitwiseXOR(F.xxhash64(p["key"])).alias("check"))
            return F.aggregate(F.filter(taken, lambda p: _place(p["key"], part) == i), cell, out)

        def taken_out(taken: Column) -> Column:
            def left(part: int) -> Column:
                return F.transform(F.slice(state["cells"], part * CELLS + 1, CELLS), lambda c, i: without(c, i, taken, part))

            cells = F.concat(*map(left, range(TABLES)))
            return F.struct(cells.alias("cells"), F.concat(state["found"], F.transform(taken, lambda p: p["key"])).alias("found"), (F.size(taken) == 0).alias("stuck"))

        return F.when(state["stuck"], state).otherwise(_let(pure, taken_out))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s["cells"]), s["found"]))


def _split(pair: Column, level: Column) -> Column:
    """Four pairs of digest sets, by two bits of the digest."""
    part = lambda k: F.call_function("shiftrightunsigned", k, (F.lit(62) - level * 2).cast("int")).bitwiseAND(F.lit(3))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")),
        lambda q: F.struct(F.filter(pair["a"], lambda k: part(k) == q).alias("a"), F.filter(pair["b"], lambda k: part(k) == q).alias("b")),
    )


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """How many digests are in one set only, recovered from the sketches, larger ones where they fail."""
    nothing = F.array().cast("array<struct<a:array<bigint>,b:array<bigint>>>")
    whole = F.struct(a.alias("a"), b.alias("b"))
    start = _let(peel(subtract(sketch_a, sketch_b)), lambda found: F.struct(F.when(found.isNull(), _split(whole, F.lit(0))).otherwise(nothing).alias("failed"), F.coalesce(F.size(found), F.lit(0)).alias("n")))

    def grow(state: Column, level: Column) -> Column:
        def tried(pair: Column) -> Column:
            return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), peel(subtract(sketch(pair["a"]), sketch(pair["b"]))).alias("found"))

        def counted(tries: Column) -> Column:
            n = F.aggregate(tries, state["n"], lambda acc, t: acc + F.coalesce(F.size(t["found"]), F.lit(0)))
            again = F.flatten(F.transform(F.filter(tries, lambda t: t["found"].isNull()), lambda t: _split(t, level)))
            return F.struct(again.alias("failed"), n.alias("n"))

        return F.when(F.size(state["failed"]) == 0, state).otherwise(_let(F.transform(state["failed"], tried), counted))

    rest = lambda s: F.aggregate(s["failed"], s["n"], lambda acc, p: acc + F.size(F.array_except(p["a"], p["b"])) + F.size(F.array_except(p["b"], p["a"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(GROWTHS)), start, grow, rest)


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return _let(difference(a, b, sketch_a, sketch_b), lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d).cast("double") / (both + d)))


def written(cells: Column) -> Column:
    """A sketch as text: count, digests and hashes of each cell in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("0")).otherwise(F.concat_ws(".", F.lower(F.hex(c["n"])), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))), " ")


def _cuts(at: Column, parts: int) -> Column:
    """Quantiles that cut numbers into so many parts of about equal size."""
    return F.array_distinct(F.percentile_approx(at, [k / parts for k in range(1, parts)] or [0.0], 20 * parts + 1000))


def _behind(cuts: Column, at: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= at))


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at`` (the id, null first) and ``part``, which ascends with it."""
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(_FIRST)))
    chars = int(rows.select(F.sum(F.length("text"))).first()[0] or 0)
    ranges = chars // RANGE_CHARS + 1
    coarse = min(MOST_CUTS, max(1, round(ranges**0.5)))
    fine = min(MOST_CUTS, -(-ranges // coarse))
    ids = rows.select("at")
    outer = F.array(*[F.lit(c).cast("long") for c in ids.agg(_cuts(F.col("at"), coarse)).first()[0] or ()]).cast("array<bigint>")
    inner = ids.groupBy(_behind(outer, F.col("at")).alias("major")).agg(_cuts(F.col("at"), fine).alias("inner"))
    told = json.dumps([r.asDict() for r in inner.collect()])  # once, so that each use of the ranges sees the same ones
    known = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<major:int,inner:array<bigint>>>")))
    within = rows.withColumn("major", _behind(outer, F.col("at"))).join(F.broadcast(known), "major")
    return within.withColumn("part", F.col("major") * (MOST_CUTS + 1) + _behind(F.col("inner"), F.col("at"))).drop("major", "inner")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, digests, next_text, next_digests``: also of the row that follows in the order of ids, of the first
    after the last."""
    placed = _ranged(id_and_text(docs, id_col, text_col))
    heads = placed.groupBy("part").agg(F.min("at").alias("at"))
    before = F.lag("part").over(Window.orderBy("part"))  # over one row per range
    last = heads.select(F.max("part").alias("last"))
    guests = heads.join(F.broadcast(last)).select("at", F.coalesce(before, "last").alias("guest_of"))
    guests = placed.select("doc_id", "text", "at").join(F.broadcast(guests), "at").select("doc_id", "text", F.col("guest_of").alias("part"), "at", F.lit(True).alias("guest"))
    every = placed.select("doc_id", "text", "part", "at", F.lit(False).alias("guest")).unionByName(guests).withColumn("digests", digests(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", "at", "text")
    led = every.withColumn("next", F.lead(F.struct("text", "digests")).over(order)).filter("NOT guest")
    return led.select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, digests, cells, fingerprint``."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", digests(F.col("text")).alias("digests"))
    return rows.withColumn("cells", sketch(F.col("digests"))).withColumn("fingerprint", written(F.col("cells")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited)
    sets = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digests").alias("a"), digests(F.col("edited")).alias("b"), F.col("next_digests").alias("c"),
    )
    for name in "abc":
        sets = sets.withColumn(f"s{name}", sketch(F.col(name)))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"), written(F.col("sb")).alias("edited_fingerprint"),
        likeness(*map(F.col, ("a", "b", "sa", "sb"))).alias("near_edited"), likeness(*map(F.col, ("a", "c", "sa", "sc"))).alias("near_next"),
    )
