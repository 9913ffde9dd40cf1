"""Document fingerprints as threshold-scaled sketches of word shingles.

A text's shingles are its runs of ``shingle`` words (a shorter text is one shingle). A sketch keeps every shingle digest
below a fixed fraction of all digests, so its size follows the text's, the sketch of a union is the union of sketches, and
the share of a small text's digests that a large one also keeps estimates containment, however unequal both are. A text
with words of which no digest is low enough keeps its lowest one, so that it still has a fingerprint; digests above the
threshold play no part in merging.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case. Everything is DataFrame functions:
no text leaves the JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpick.llm.common import materialize
from labelpick.operators.ranks import sorted_ranges
from labelpick.session import scratch_path

SHINGLE = 5
FRACTION = 8  # one of so many digests is kept
DIGITS = 16   # hex digits of a kept digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUEST = 1 << 33  # place of a row that only lends its text


def limit(fraction: int = FRACTION) -> str:
    """Digests below this text are kept."""
    if fraction < 1:
        raise ValueError("fraction must be 1 or more: one of so many digests is kept")
    return "g" if fraction == 1 else f"{-(-(1 << 64) // fraction):016x}"


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS)
    return F.filter(parts, lambda w: w != "")


def with_sketch(rows: DataFrame, text_col: str, name: str, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """``rows`` with the sorted digests of a text's sketch as array ``name``."""
    word, low = f"{name}_words", f"{name}_low"

    def digest(parts: Column) -> Column:
        return F.substring(F.md5(parts), 1, DIGITS)

    n = F.size(word)
    runs = F.transform(F.sequence(F.lit(0), n - shingle),
                       lambda i: digest(F.concat_ws(" ", *[F.get(word, i + j) for j in range(shingle)])))
    every = F.when(n >= shingle, runs).when(n > 0, F.array(digest(F.array_join(word, " ")))).otherwise(
        F.array().cast("array<string>"))
    # each step is used more than once by the next, which keeps Spark from computing it anew
    split = rows.withColumn(word, words(F.col(text_col)))
    kept = split.withColumn(low, F.array_sort(F.array_distinct(F.filter(every, lambda h: h < limit(fraction)))))
    lowest = F.when(F.size(word) > 0, F.array(F.array_min(every))).otherwise(F.array().cast("array<string>"))
    return kept.withColumn(name, F.when(F.size(low) > 0, F.col(low)).otherwise(lowest)).drop(word, low)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's text that is also in the second's; nothing is contained in anything."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             fraction: int = FRACTION) -> DataFrame:
    """(doc_id, n_words, sketch) of every row. Null and empty texts have an empty sketch; other columns are ignored."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    split = with_sketch(rows, "text", "sketch", shingle, fraction)
    return split.select("doc_id", F.size(words(F.col("text"))).alias("n_words"), "sketch")


def merged(docs: DataFrame, group_col: str, text_col: str = "text", shingle: int = SHINGLE,
           fraction: int = FRACTION) -> DataFrame:
    """(group, digest): the sketch of all texts of each group together, one row per digest.

    As rows it has no bound: a group with a third of all documents spreads over all tasks.
    """
    rows = docs.select(docs[group_col].alias("group"), docs[text_col].cast("string").alias("text"))
    long = with_sketch(rows, "text", "sketch", shingle, fraction).select("group", F.explode("sketch").alias("digest"))
    return long.where(F.col("digest") < limit(fraction)).distinct()


def containment_in(small: DataFrame, large: DataFrame, key: str, group: str = "group") -> DataFrame:
    """(key, group, shared, of, containment): which share of each key's digests each group holds, where it holds any.

    ``small`` holds (key, digest) and ``large`` (group, digest), both distinct, as ``merged`` gives them. One digest is in
    a group once, so the join makes at most one row per digest of ``small`` and group.
    """
    size = small.groupBy(key).agg(F.count("*").alias("of"))
    shared = small.join(large, "digest").groupBy(key, group).agg(F.count("*").alias("shared"))
    return shared.join(size, key).select(key, group, "shared", "of", (F.col("shared") / F.col("of")).alias("containment"))


def with_next(rows: DataFrame) -> DataFrame:
    """(block, place, ...) of (doc_id, text), by descending doc_id, as a table in which neighbours share a block.

    A block is a range of the order. Behind its last row it holds a copy of the first row of the next block (behind the
    last block, of the first one), so every row finds its next one without leaving its block. Null ids come last, equal
    ids are ordered by the digest of the text. The table is bucketed by block: texts are shuffled once, to be sorted.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
    ranged = sorted_ranges(tied, F.col("doc_id").desc_nulls_last(), "tie").select(
        F.col("_part").alias("block"), F.col("_row").alias("place"), "doc_id", "text")
    table = f"ranges_{uuid.uuid4().hex}"
    buckets, path = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), scratch_path(spark, table)

    def store(part: DataFrame) -> None:
        (part.write.mode("append").format("parquet").option("path", path).option("compression", "zstd")
         .bucketBy(buckets, "block").saveAsTable(table))

    store(ranged)
    heads = spark.table(table).where("place = 0")
    order = [r["block"] for r in heads.select("block").orderBy("block").collect()]  # one number per range
    if not order:
        return spark.table(table)
    before = spark.createDataFrame(list(zip(order, [order[-1], *order])), "block long, last long")
    guests = materialize(heads.join(F.broadcast(before), "block").select(
        F.col("last").alias("block"), F.lit(GUEST).cast("long").alias("place"), "doc_id", "text"), "guests")
    store(guests)
    return spark.table(table)


def fingerprint_report(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document by
    descending id, after the last the first; a shorter next document gives all it has. Null texts count as empty: their
    fingerprint is the empty text, and two empty texts are alike (1.0). A single document is its own next one. Repeated
    rows are documents of their own. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    placed = with_sketch(with_next(rows), "text", "sketch", shingle, fraction)
    along = Window.partitionBy("block").orderBy("place")
    pairs = placed.select("doc_id", "place", "text", "sketch", F.length("text").cast("long").alias("n_chars"),
                          F.lead("text").over(along).alias("next_text"), F.lead("sketch").over(along).alias("next_sketch"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
                      F.substring("next_text", F.lit(1), third))
    changed = with_sketch(pairs.where(F.col("place") < GUEST).withColumn("edited", edited), "edited", "edited_sketch",
                          shingle, fraction)
    return changed.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                          fingerprint(F.col("sketch")).alias("fingerprint"),
                          fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                          likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                          likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
