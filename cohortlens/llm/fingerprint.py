"""Document fingerprints: one-permutation MinHash with optimal densification, packed to b bits.

Each five-word shingle is hashed once. The high bits choose one of ``BINS``
bins, the smallest hash of a bin is its value. An empty bin takes the value of
another bin that a hash of (attempt, bin) names, attempt after attempt, until
one is not empty; after ``ATTEMPTS`` of them the order of the remaining ones is
that of a hash of (empty bin, filled bin), which comes to the same without a
loop. Stored are the ``BITS`` low-order bits of every value, packed as a
hexadecimal string. Two unrelated bins agree with probability 2^-BITS, so the
likeness is (share of equal bins - 2^-BITS) / (1 - 2^-BITS), cut at 0.

DataFrame functions only; a document's fingerprint is an expression over its
row, nothing is exploded or shuffled for it.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer than
five words has one shingle, all of them; NULL and texts without words have none and
the fingerprint ''. Two of these are alike 1.0, one of them and any other 0.0.

``edited_pairs`` compares each document with an edit of it and with its
successor in descending doc_id. Ties of doc_id are ordered by a hash of the
text, a NULL doc_id comes last; repeated rows each have their own row. A
single document is its own successor. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import BLANKS, fresh, lower_ascii

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
ATTEMPTS = 8


def with_minima(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of the low-order bits of all bins; empty without shingles."""
    w, h, s, m, d = fresh(df, "f_words", "f_hashes", "f_shingles", "f_minima", "f_dense")
    words = F.filter(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), BLANKS), lambda x: x != "")
    df = df.withColumn(w, words).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*(F.get(F.col(h), i + k) for k in range(SHINGLE))),
    )
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    df = df.withColumn(s, F.sort_array(F.when(n >= SHINGLE, grams).when(n > 0, whole).otherwise(F.array().cast("array<long>"))))
    first = F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1))))
    df = df.withColumn(m, first)
    # minima in the place of their bins, NULL between them
    nothing = F.lit(None).cast("long")
    runs = F.transform(
        m,
        lambda x, i: F.concat(
            F.array_repeat(nothing, (_bin(x) - F.coalesce(_bin(F.get(F.col(m), i - 1)), F.lit(-1)) - 1).cast("int")), F.array(x)
        ),
    )
    df = df.withColumn(d, F.flatten(runs))

    def filled(b: Column) -> Column:
        tries = [F.get(F.col(d), F.pmod(F.xxhash64(F.lit(t), b), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
        nearest = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(F.lit(-1), b, _bin(x)).alias("r"), x.alias("v"))))
        return F.coalesce(F.get(F.col(d), b), *tries, nearest["v"])

    low = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: filled(b).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    df = df.withColumn(out, F.when(F.size(m) > 0, low).otherwise(F.array().cast("array<int>")))
    return df.drop(w, h, s, m, d)


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 64 - BIN_BITS) + F.lit(BINS // 2)).cast("int")


def packed(bits: Column) -> Column:
    """The hexadecimal string of an array of low-order bits."""
    return F.lower(F.array_join(F.transform(bits, lambda x: F.hex(x.cast("long"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingle sets behind two arrays of low-order bits."""
    chance = 2.0**-BITS
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))
    )


def fingerprints(documents: DataFrame, out: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint of the whole text as one more column."""
    (bits,) = fresh(documents, "f_bits")
    return with_minima(documents, "text", bits).withColumn(out, packed(F.col(bits))).drop(bits)


def _ranges(docs: DataFrame) -> Column:
    """The range of doc_id that a row belongs to, from about as many quantiles as there are shuffle partitions."""
    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    above = F.size(F.filter(table, lambda b: b < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(above)


def with_successor(docs: DataFrame, columns: list[str], derive=lambda df: df) -> DataFrame:
    """``derive(docs)`` with next_<c> for each of ``columns``, those of the next row in descending doc_id; the last has the first.

    Rows move once, to the task of their doc_id range, and the window runs
    inside a range. The first row of each range (one per range) is fetched for
    the last row of the range before.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    ranged = docs.withColumn("range", _ranges(docs))
    heads = sorted(
        ((r["range"], r["head"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("head")).collect()), reverse=True
    )
    follow = [(a[0], b[1]) for a, b in zip(heads, heads[1:] + heads[:1])]
    next_heads = spark.createDataFrame(follow, "after int, head_id long")
    found = derive(docs.join(F.broadcast(next_heads), F.col("doc_id").eqNullSafe(F.col("head_id"))))
    first = F.row_number().over(Window.partitionBy("after").orderBy(tie))
    found = found.withColumn("r", first).where("r = 1").select("after", *(F.col(c).alias(f"head_{c}") for c in columns))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), tie)
    inside = derive(ranged).withColumn("is_last", F.lead(F.lit(1)).over(order).isNull())
    for c in columns:
        inside = inside.withColumn(f"in_{c}", F.lead(c).over(order))
    both = inside.join(found, (F.col("range") == F.col("after")) & F.col("is_last"), "left")
    return both.select(
        *(c for c in inside.columns if c not in ("range", "is_last") and not c.startswith("in_")),
        *(F.when(F.col("is_last"), F.col(f"head_{c}")).otherwise(F.col(f"in_{c}")).alias(f"next_{c}") for c in columns),
    )


def edited_pairs(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likenesses."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    both = with_successor(docs, ["text", "bits"], lambda df: with_minima(df, "text", "bits"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    both = with_minima(both, "edited", "edited_bits")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
