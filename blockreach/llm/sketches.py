"""Threshold-scaled sketches of documents. DataFrame functions only.

A sketch keeps every shingle hash (five words, lower case) below a fixed fraction of the hash range. Its
size grows with the document, so the share of the smaller sketch that the larger one holds estimates
containment however unequal the documents are, and the sketch of a union is the union of the sketches.
A text of fewer words is one shingle. A text none of whose hashes falls below the fraction keeps its
smallest hash, so that short texts can be compared.

Null and empty texts have an empty sketch; two empty sketches are alike (1), an empty and another are not
(0). ``with_next`` orders rows by id (null ids last, rows of one id by the hash of their text); repeated
rows stay, each followed by its own copy. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.llm.common import written
from blockreach.llm.secrets import let

SHINGLE_WORDS = 5
FRACTION = 1 / 8


def sketch(text: Column, fraction: float = FRACTION, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct shingle hashes below ``fraction`` of the unsigned 64-bit range."""
    none, highest = F.array().cast("array<bigint>"), int(fraction * 2**63) - 1

    def shingles(words: Column) -> Column:
        last = F.greatest(F.size(words) - shingle_words, F.lit(0))
        # Words beyond the end are null, which the hash passes over.
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle_words)]))

    def kept(hashes: Column) -> Column:
        below = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 1) <= highest)
        smallest = F.element_at(F.array_sort(F.transform(hashes, lambda h: F.struct(F.shiftrightunsigned(h, 1).alias("order"), h.alias("h")))), 1)["h"]
        return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(F.array(smallest))

    def of_words(words: Column) -> Column:
        return F.when(F.size(words) == 0, none).otherwise(let(shingles(words), kept))

    hashed = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashed, of_words)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of a union from the sketches of its parts."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: F.shiftrightunsigned(h, 1) <= int(fraction * 2**63) - 1)
    return F.when(F.size(below) > 0, below).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger holds, 0 to 1."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise((F.size(a) == F.size(b)).cast("double"))


def as_text(hashes: Column) -> Column:
    """A sketch as hexadecimal digits, 16 per hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "").alias("fingerprint")


def followers(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct ``doc_id, twin``) with ``next``, the key that follows in descending order, the first after the last.

    Keys are range partitioned; a window finds the next key inside each partition, and the heads of the
    partitions (one row each) close the gaps between them.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("twin").desc()]
    ranged = written(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered-keys")
    heads = ranged.groupBy("part").agg(F.max_by(F.struct("doc_id", "twin"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "twin")).alias("head")).orderBy("part").collect()
    if not heads:
        return keys.withColumn("next", F.struct("doc_id", "twin"))
    after = [(a["part"], b["head"]) for a, b in zip(heads, heads[1:] + heads[:1])]
    closing = keys.sparkSession.createDataFrame(after, f"part int, head struct<doc_id:{dict(keys.dtypes)['doc_id']},twin:bigint>")
    following = F.lead(F.struct("doc_id", "twin")).over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("next", following).join(F.broadcast(closing), "part").withColumn("next", F.coalesce("next", "head")).drop("part", "head")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its ``doc_id, text, n_chars``, the text's edited form, and the next document's sketch.

    In ``edited`` the last third of the text's code points is replaced by as many of the next document's
    first (or all of them).
    """
    texts = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text"))
    counted = texts.select("doc_id", "twin", F.length("text").alias("n_chars")).groupBy("doc_id", "twin").agg(F.min("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    pairs = written(followers(counted), "document-pairs")
    repeated = pairs.where("copies > 1").select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "copies")
    steps = pairs.select("doc_id", "twin", "n_chars", "next", F.lit(1).cast("bigint").alias("times"))
    if not repeated.isEmpty():
        # All copies but the last are followed by a copy of themselves; one text of each is enough.
        steps = steps.unionByName(pairs.where("copies > 1").select("doc_id", "twin", "n_chars", F.struct("doc_id", "twin").alias("next"), (F.col("copies") - 1).alias("times")))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t"))
        texts = texts.join(repeated, same, "left_anti").unionByName(texts.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "twin"]))
    # The key also stands for the id, null ids included, so both joins read the same shuffled texts.
    def key_of(doc_id: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))

    texts = texts.select(key_of(F.col("doc_id")).alias("k"), "twin", "text")
    steps = steps.select(
        key_of(F.col("next.doc_id")).alias("k"), F.col("next.twin").alias("twin"),
        key_of(F.col("doc_id")).alias("own_k"), F.col("twin").alias("own_twin"), "n_chars", "times",
    )
    replaced = F.floor(F.col("n_chars") / 3).cast("int")
    begun = steps.join(texts, ["k", "twin"]).select(
        F.col("own_k").alias("k"), F.col("own_twin").alias("twin"), "n_chars", "times",
        F.substring(F.col("text"), F.lit(1), replaced).alias("head"), sketch(F.col("text")).alias("next_sketch"),
    )
    rows = texts.join(begun, ["k", "twin"])
    if steps.where("times > 1").isEmpty():
        rows = rows.drop("times")
    else:
        rows = rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times"))))
    doc_id = F.when(F.col("k") != "", F.expr("substring(k, 2)")).cast(dict(df.dtypes)[id_col]).alias("doc_id")
    return rows.select(doc_id, "text", "n_chars", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - replaced), F.col("head")).alias("edited"), "next_sketch")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited`` and ``near_next``."""
    rows = with_next(df, id_col, text_col).select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array(sketch(F.col("text")), sketch(F.col("edited")), F.col("next_sketch")).alias("s"),
    )
    own, edited, following = (F.get("s", F.lit(i)) for i in range(3))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
