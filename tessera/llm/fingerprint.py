"""Document fingerprints: bottom-k sketches of word-shingle hashes.

Built from DataFrame functions only.  A sketch is the ascending array of the k
smallest distinct 64-bit shingle hashes, read as unsigned numbers.  The sketch of a
union is the bottom k of the merged sketches, so parts of a document, a source or a
corpus are sketched apart and merged.  Two sketches estimate resemblance (Jaccard),
containment and the number of distinct shingles.

Shingles are five lower-cased words; a text of fewer words is one shingle, a text
without words has the empty sketch.  A null text counts as empty.  Two empty sketches
resemble each other fully, an empty one and another not at all.

Defined results besides: texts of any length are read whole; repeated rows give equal sketches, one row each; rows with
tied ids stand in the order of their texts, rows without an id before all others (one repeated id, or none, is one range
and so one task); an empty table gives no rows; extra columns are ignored, whatever they are called.

Hashes are kept as signed longs with the top bit flipped, so that Spark's signed
order is the unsigned order of the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE_WORDS = 5
K = 128
_BLANKS = " \t\n\x0b\f\r"
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of a text, repeats included."""

    def of_words(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        return let(hashed, of_hashes)

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        whole = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        short = F.array(F.xxhash64(F.concat_ws(",", F.transform(h, lambda x: x.cast("string")))))
        return F.when(F.size(h) >= width, whole).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACES)).otherwise(F.array().cast("array<string>"))
    return let(words, of_words)


def sketch(text: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    union = merge(a, b, k)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(let(union, lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / F.greatest(place, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too (0 to 1)."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merged_sketches(df: DataFrame, group: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group, merged from the sketches of its rows.

    Hashes are made distinct before they are ranked and only the k smallest of each
    map task travel on, so a hot group costs each task k rows.
    """
    hashes = df.select(*group, F.explode(sketch_col).alias("__h")).distinct()
    ranked = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("__h"))).where(F.col("__n") <= k)
    return ranked.groupBy(*group).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def to_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id``, ``text``, ``sketch`` and the next document's ``next_text``, ``next_sketch``.

    The order is ascending id (null first), then text; after the last comes the first.
    Documents are dealt by ranges of ids that hold about as many rows each (one
    quantile pass over the ids), four for each shuffle partition; every range also gets a copy
    of the next range's first row, so no task sees more than its range and whole
    texts are shuffled once.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.select(F.percentile_approx("id", shares or [0.5], 10 * ranges).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    docs = docs.withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(_below(F.col("id"), bounds)))

    firsts = docs.groupBy("range").agg(F.min("id").alias("first"))
    # one row per range, four for each shuffle partition at most: small, whatever the documents
    whole = Window.partitionBy(F.lit(0)).orderBy("range")
    ends = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("range", "first", F.coalesce(F.lag("range").over(whole), F.last("range").over(ends)).alias("before"))
    joined = docs.join(F.broadcast(heads), "range")
    is_first = F.col("id").eqNullSafe(F.col("first"))
    places = F.when(is_first, F.array(F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))
    )
    dealt = joined.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.range", "at.copy")
    dealt = dealt.repartition("range").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", "id", "text")
    following = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return following.where(~F.col("copy")).select("id", "text", "sketch", "next_text", "next_sketch")


def _below(value: Column, bounds: list) -> Column:
    """How many bounds lie at or below the value: a binary search, log2(bounds) steps."""
    if not bounds:
        return F.lit(0)
    # one literal, however many bounds: the optimizer folds the split
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if isinstance(bounds[0], int) else F.array(*map(F.lit, bounds))
    n, steps = len(bounds), len(bounds).bit_length()

    def search(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            inside, right = s["lo"] < s["hi"], F.get(a, mid) <= value
            return F.struct(
                F.when(inside & right, mid + 1).otherwise(s["lo"]).alias("lo"),
                F.when(inside & ~right, mid).otherwise(s["hi"]).alias("hi"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])

    return let(table, search)


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the next text's start."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
