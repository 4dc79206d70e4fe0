"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions.

The lexicon keeps the terms whose document frequency lies in a band (equally: whose
inverse document frequency does). A text's distinct lexicon terms are sorted, and every
one of ``SUBSETS`` random subsets of the lexicon hashes those of them that it holds. The
subsets come in levels, from a quarter to a thousandth of the lexicon, so that texts of
any length have a level whose subsets hold only a few of their terms; an edit leaves some
of those as they were. Two texts are as like as the best level says: its share of equal
hashes among the subsets that hold a term of either text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The band: a lexicon term occurs in at least LEAST and at most MOST of the documents. A
#: group of copies may hold a third of all rows, and its terms must stay in the band.
LEAST, MOST = 0.002, 0.5
#: Terms kept of a text for the case that none of its terms is in the lexicon.
SPARE = 16
#: Subsets of each level and the levels' rates.
EACH, RATES = 8, (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024)
SUBSETS = EACH * len(RATES)
#: A level with fewer subsets in use than this counts as if it had so many.
FEWEST = 4
#: Ranges of rows that are dealt out: about RANGE_ROWS rows each, LEVEL x LEVEL ranges at
#: most (which bounds the tables of bounds and first rows), SAMPLED keys drawn for each.
LEVEL, RANGE_ROWS, SAMPLED = 128, 64, 8
#: Lexicon entries (16 bytes each) up to which the lexicon is broadcast.
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct lower-cased terms (runs of letters and digits); the first is always ''."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[^\p{L}\p{N}]+")))


def spare(t: Column) -> Column:
    """The least hashes of a text's terms: an edit elsewhere leaves them as they were."""
    return F.slice(F.sort_array(F.transform(F.slice(t, 2, 2**30), lambda x: F.xxhash64(x))), 1, SPARE)


def lexicon(docs: DataFrame, n_docs: int, text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term, mask): hashes of the terms in the band and the subsets that hold them.

    Document frequencies count all documents. Each kept term is in ``least`` of the
    documents or more, so there are at most (mean distinct terms of a document) / least
    of them at any corpus size; that bound is what allows the broadcast. The term ''
    (mask 0) stands in for every text's own row."""
    counted = docs.select(F.explode(terms(common.whole(docs[text_col]))).alias("t")).select(F.xxhash64("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = counted.where((F.col("df") >= max(2.0, least * n_docs)) & (F.col("df") <= max(2.0, most * n_docs))).select("term")
    below = F.array(*[F.lit(int((2 * r - 1) * 2.0**63)) for r in RATES])
    mask = F.aggregate(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)),
        F.lit(0).cast("long"),
        lambda held, k: held.bitwiseOR(F.when(F.xxhash64(F.col("term"), k) < F.get(below, F.floor(k / EACH).cast("int")), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))),
    )
    own = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(0).cast("long").alias("mask"))
    return kept.where(F.col("term") != F.xxhash64(F.lit(""))).select("term", mask.alias("mask")).unionByName(own)


def _holds(bits: int):
    return lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0


def _levels(held: str) -> list[Column]:
    """The entries of each level: one pass per level spares one pass per subset."""
    return [F.filter(F.col(held), _holds((2**EACH - 1) << (EACH * v))).alias(f"{held}{v}") for v in range(len(RATES))]


def _components(held: str, fallback: str, spares: str) -> Column:
    """The subset hashes of sorted (term, mask) structs, null where a subset holds none.
    A text with no lexicon term has its spare terms, each in the place that its hash names,
    on the first level and the hash of the whole text in every other place; a text with no
    term at all has the latter everywhere."""
    inside = [F.filter(F.col(f"{held}{k // EACH}"), _holds(1 << k)) for k in range(SUBSETS)]
    own = F.array(*[F.when(F.size(s) > 0, F.xxhash64(s, F.lit(k))) for k, s in enumerate(inside)])
    placed = F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), lambda k: F.array_min(F.filter(F.col(spares), lambda h: F.pmod(h, F.lit(EACH)) == k)))
    coarse = F.array_repeat(F.col(fallback), SUBSETS)
    finer = F.concat(placed, F.slice(coarse, 1, SUBSETS - EACH))
    return F.when(F.size(held) > 0, own).when(F.size(spares) > 0, finer).otherwise(coarse)


def _pairs(a: str, b: str) -> Column:
    """2 for subsets with equal hashes, 1 for others that hold a term, else 0."""
    return F.zip_with(F.col(a), F.col(b), lambda x, y: F.when(x == y, F.lit(2)).when(x.isNotNull() | y.isNotNull(), F.lit(1)).otherwise(F.lit(0)))


def _likeness(pairs: str) -> Column:
    def share(v: Column) -> Column:
        level = F.slice(F.col(pairs), v * EACH + 1, F.lit(EACH))
        return F.size(F.filter(level, lambda p: p == 2)) / F.greatest(F.size(F.filter(level, lambda p: p > 0)), F.lit(FEWEST))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(RATES) - 1)), share))


def _text_form(components: str) -> Column:
    return F.array_join(F.transform(F.col(components), lambda x: F.coalesce(F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), F.lit("-"))), ".")


def _key(id_col: str, th: str) -> Column:
    """A text that sorts as (id, hash) do, null ids first."""
    def digits(c: str) -> Column:
        return F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(2**63)))), 16, "0")

    return F.concat(F.when(F.col(id_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), digits(id_col))), digits(th))


def _placed(rows: DataFrame, bounds: list[str]) -> DataFrame:
    """``rows`` with ``own``: the number of ``bounds`` up to their key, found on two levels."""

    def upto(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: (b != "") & (b <= F.col("key"))))

    coarse, fine = (F.split(F.lit(",".join(b)), ",") for b in (bounds[LEVEL - 1 :: LEVEL], bounds))
    return rows.withColumn("at", upto(coarse) * LEVEL).withColumn("own", F.col("at") + upto(F.slice(fine, F.col("at") + 1, F.lit(LEVEL)))).drop("at")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, guest, id, text, next_text): each row beside the next by ascending id, the
    last beside the first. Rows with guest = 1 are copies that only serve the row before.

    Rows are ordered by id (nulls first) and a hash of the text, and dealt out in ranges
    whose bounds come from a sample of these keys, so far or repeated ids don't crowd one
    range; only rows equal in id and text stay together. Each range is a window of its own,
    and its first row is copied to the range before."""
    text = common.whole(docs[text_col])
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th")).withColumn("key", _key("id", "th"))
    n = rows.count()
    parts = min(LEVEL * LEVEL, max(1, math.ceil(n / RANGE_ROWS)))
    drawn = rows.where(F.pmod(F.xxhash64("id", "th", F.lit(1)), F.lit(max(1, n // (SAMPLED * parts)))) == 0).select("key").distinct()
    keys = sorted(r.key for r in drawn.toLocalIterator()) if parts > 1 else []
    rows = _placed(rows, sorted({keys[len(keys) * k // parts] for k in range(1, parts)} if keys else ()))
    firsts = rows.groupBy("own").agg(F.min("key").alias("first_key"))
    over = Window.orderBy("own")
    last = Window.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one short row for each range, LEVEL x LEVEL at most
    firsts = firsts.select(F.col("own").alias("o"), "first_key", F.coalesce(F.lag("own").over(over), F.last("own").over(last)).alias("target"))
    placed = rows.join(F.broadcast(firsts), (F.col("own") == F.col("o")) & (F.col("key") == F.col("first_key")), "left")
    home = F.struct(F.col("own").alias("part"), F.lit(0).alias("guest"))
    away = F.struct(F.col("target").alias("part"), F.lit(1).alias("guest"))
    dealt = placed.select("id", "text", "th", F.explode(F.when(F.col("target").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("to")).select("to.part", "to.guest", "id", "text", "th")
    return dealt.withColumn("next_text", F.lead("text").over(Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), "th")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document. A null text is an empty one; texts without
    terms are like only to equal texts, those without lexicon terms are told by their
    spare terms. Repeated rows give repeated
    results; a document alone is its own next. Other columns are ignored."""
    held = common.stored(lexicon(docs, docs.count(), text_col), "lexicon")
    if held.count() <= BROADCAST_TERMS:
        held = F.broadcast(held)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited)
    own = F.struct("id", "guest", "th", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.xxhash64("edited").alias("eh"), spare(terms(F.col("text"))).alias("sa"), spare(terms(F.col("edited"))).alias("sb"))
    both = F.array(F.struct(F.lit(0).alias("of"), terms(F.col("text")).alias("t")), F.struct(F.lit(1).alias("of"), terms(F.col("edited")).alias("t")))
    split = rows.select("part", F.monotonically_increasing_id().alias("row"), own.alias("own"), both.alias("both"))
    one = split.select("part", "row", "own", F.explode("both").alias("b")).select("part", "row", "own", F.col("b.of").alias("of"), F.explode("b.t").alias("t"))
    hits = one.select("part", "row", "of", F.xxhash64("t").alias("term"), F.when((F.col("t") == "") & (F.col("of") == 0), F.col("own")).alias("own")).join(held, "term")
    entry, real = F.struct("term", "mask"), F.col("term") != F.xxhash64(F.lit(""))
    listed = hits.groupBy("part", "row").agg(
        F.array_sort(F.collect_list(F.when((F.col("of") == 0) & real, entry))).alias("a"),
        F.array_sort(F.collect_list(F.when((F.col("of") == 1) & real, entry))).alias("b"),
        F.first("own", ignorenulls=True).alias("own"),
    )
    made = listed.select("part", "own.*", "a", "b", *_levels("a"), *_levels("b")).select("part", "id", "guest", "th", "n_chars", "sha", _components("a", "th", "sa").alias("a"), _components("b", "eh", "sb").alias("b"))
    made = made.withColumn("c", F.lead("a").over(Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), "th")))
    return made.where("guest = 0").select("*", _pairs("a", "b").alias("edit_pairs"), _pairs("a", "c").alias("next_pairs")).select(
        F.col("id").alias(id_col),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        _text_form("a").alias("fingerprint"),
        _text_form("b").alias("edited_fingerprint"),
        _likeness("edit_pairs").alias("near_edited"),
        _likeness("next_pairs").alias("near_next"),
    )
