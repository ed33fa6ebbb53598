"""Threshold-scaled document fingerprints, in DataFrame functions alone.

A text's fingerprint keeps every 5-word shingle hash below a fixed fraction of
the 64-bit range (the shingles of ``[^\\x20\\x09-\\x0D]+`` words, A-Z
lower-cased; a text with fewer words is one shingle). Two fingerprints merge by
union, and because the cut is the same for all texts, the share of a small text's
hashes found in a large one estimates containment whatever the sizes. A text
with words, none of whose hashes is below the cut, keeps its smallest hash, so
that it is never mistaken for an empty one; a merge drops such a hash as soon as
there is one below the cut. Such a hash says nothing of what other texts contain, so
the containment of a text that has no other is unknown (null).

The printed form is the sorted hashes as 16 hexadecimal digits each.

Defined cases: a null or empty text, or one without words, has the empty
fingerprint; two empty fingerprints are alike (1), an empty and another are not
(0). Repeated rows are fingerprinted one by one; among rows of one doc_id the
order of ``next`` is that of their texts' hashes; null doc_ids come first. Other columns
of the input are kept by ``fingerprint``; a clash with the result's name is
solved by renaming the input's column (an underscore in front).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.functions.positions import ACCURACY, RANGES, block_of, range_cuts
from tabsmith.llm.store import documents, free_name, save

SHINGLE = 5
FRACTION = 4                    # one hash in so many is kept
#: Documents whose successors are found in one window.
BLOCK = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = -(1 << 63) + (1 << 64) // FRACTION


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for none."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch_of(words: Column) -> Column:
    """The sorted hashes a text keeps (array of long)."""
    # a shingle's hash is that of its words' hashes
    def several(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE),
                           lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))

    def shingles(h: Column) -> Column:
        return (F.when(F.size(h) >= SHINGLE, several(h)).when(F.size(h) > 0, F.array(F.xxhash64(h)))
                .otherwise(F.array().cast("array<bigint>")))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(shingles(h), keep_low))


def keep_low(hashes: Column) -> Column:
    def choose(low: Column) -> Column:
        return (F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low)))
                .when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>")))
    return let(F.filter(hashes, lambda h: h < LIMIT), choose)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return let(F.array_union(a, b), keep_low)


def printed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles among all shingles of two texts."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second has; null if the first has no hash below the cut."""
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.get(a, F.lit(0)) < LIMIT, share)


def fingerprint(docs: DataFrame, *, text_col: str = "text", name: str = "sketch") -> DataFrame:
    """``docs`` plus the sketch (array of long) of its texts."""
    if name in docs.columns:
        docs = docs.withColumnRenamed(name, free_name(docs.columns, name))
    return docs.withColumn(name, sketch_of(words_of(F.col(text_col))))


def _blocks(rows: DataFrame) -> Column:
    """The number of a row's block, rising with (id, key), null ids first.

    Cuts lie at sampled quantiles of the ids, so a far-off id shares no block with many
    others; an id (or none) that repeats over whole blocks is cut again by key."""
    some = rows.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.min("id").alias("lo"),
                    F.max("id").alias("hi")).first()
    ranges = min(RANGES, max(2, some.n // BLOCK))
    bits = min(20, (some.n // BLOCK).bit_length())          # of a repeated id's cuts
    by_key = F.shiftright("key", 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0)
    none = by_key if some.n - some.known > 2 * BLOCK else F.lit(0)
    inside, found = F.lit(0), F.lit(0)
    if some.known:
        sampled = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], ACCURACY)).first()[0]
        heavy = sorted({a for a, b in zip(sampled, sampled[1:]) if a == b})
        parts = max(1, -(-some.n // (ranges * BLOCK)))
        cuts = range_cuts(some.lo, some.hi, [*sampled, *heavy, *(h + 1 for h in heavy)], parts)
        found = block_of(F.col("id"), cuts, parts)
        if heavy:
            inside = F.when(F.col("id").isin(heavy), by_key).otherwise(F.lit(0))
    return F.when(F.col("id").isNull(), none - F.lit(1 << bits)).otherwise(found * F.lit(1 << bits) + inside).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, derived: dict[str, Column]) -> DataFrame:
    """(id, text, derived columns, next: struct of text and derived columns of the
    next row by id). The last row's next is the first row.

    Rows are dealt into blocks of ids; each block also gets the first row of the
    block after it, so one shuffle of the rows finds all successors. Only one row
    for a block of about BLOCK rows is ordered in one place. ``derived`` is
    computed once a row, from ``text``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("block", _blocks(rows))
    heads = rows.groupBy("block").agg(F.min(F.struct("id", "key")).alias("head"))       # a null id is the smallest
    order = Window.orderBy("block")
    last = F.max("block").over(Window.partitionBy())
    heads = heads.select(F.col("block").alias("of"), F.col("head.id").alias("head_id"), F.col("head.key").alias("head_key"),
                         F.coalesce(F.lag("block").over(order), last).alias("to"))
    # saved, so that its size is known before the join: a small table is sent to the rows, not the rows to it
    heads = save(heads, "fingerprint-heads")
    guests = (rows.join(heads, (F.col("block") == F.col("of")) & F.col("id").eqNullSafe(F.col("head_id"))
                        & (F.col("key") == F.col("head_key")))
              .dropDuplicates(["of"])
              .select("id", "text", "key", F.col("to").alias("block"), F.lit(1).alias("guest")))
    together = rows.withColumn("guest", F.lit(0)).unionByName(guests).withColumns(derived)
    values = ["text", *derived]
    w = Window.partitionBy("block").orderBy("guest", F.col("id").asc_nulls_first(), "key")
    return (together.withColumn("next", F.lead(F.struct(*values)).over(w)).where("guest = 0")
            .select("id", *values, "next"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(documents(spark, sf_dir), "doc_id", "text", {"sketch": sketch_of(words_of(F.col("text")))})
    edited = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next.text")))
    edited = edited.withColumn("edited_sketch", sketch_of(words_of(F.col("edited"))))
    return edited.select(
        F.col("id").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"))
