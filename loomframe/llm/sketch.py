"""Bottom-k sketches of word-shingle hashes, with Spark expressions only.

A text's shingles are its five-word windows (fewer words: the whole sequence; none: no shingle).
Its sketch is the sorted array of the K smallest different 64-bit shingle hashes. Sketches merge
by union; the K smallest of a union estimate resemblance (share that both have), containment
and the number of different shingles.

Defined results: null and blank texts have an empty sketch, like any other empty one; equal texts have equal sketches, so ties and repeated
rows need no rule; a very long text is sketched whole in its row; null parts merge as a part of their own; a column called as a new one keeps its
name and the new one gets underscores; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomframe.llm.common import free_name

K = 128
SHINGLE_WORDS = 5
WHITE = " \t\n\x0b\f\r"
#: Rows of an order bucket that next_texts aims at, and the most buckets whose heads are broadcast (24 bytes each).
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 19
KNOTS = 64
#: Rows that a task of next_texts aims at.
TASK_ROWS = 8_192


def words(text: Column) -> Column:
    """Runs of characters outside x20, x09-x0D; null and blank: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def bottom_k(words: Column, k: int = K, n: int = SHINGLE_WORDS) -> Column:
    """The sketch of an array of words; words should be a plain column, as it is used many times."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    hashes = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < n, few).otherwise(many)
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; of two empty sketches 1."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty sketch 1."""
    inside = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside / F.greatest(F.lit(1.0), distinct_shingles(a, k))))


def fingerprint_text(a: Column) -> Column:
    """A sketch as lowercase hex, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def sketched(df: DataFrame, text: str = "text", k: int = K, out: str = "sketch") -> DataFrame:
    """df with its texts' sketches in a new column (underscores before the name if df has it)."""
    held, made = free_name(df, "__words"), free_name(df, out)
    return df.withColumn(held, words(F.col(f"`{text}`"))).withColumn(made, bottom_k(F.col(held), k)).drop(held)


def merge_parts(df: DataFrame, part: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(part, sketch) of all rows of each part.

    Equal hashes of a part are one row before they are ranked, so copies cost nothing, and Spark keeps
    k hashes a part and task before the last shuffle, so a hot part is small there.
    """
    each = df.select(F.col(f"`{part}`").alias("p"), F.explode_outer(F.col(f"`{sketch}`")).alias("h")).distinct()
    least = each.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy(F.asc_nulls_last("h")))).where(F.col("r") <= k)
    return least.groupBy("p").agg(F.array_sort(F.collect_list("h")).alias(sketch)).withColumnRenamed("p", part)


def next_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, bucket, is_copy): every row, in order buckets of ids, with the row that follows a bucket copied to its end.

    Ids descend from bucket to bucket and in each; null ids come last, rows with the same id in the
    order of their texts' hashes. Buckets come from 64 approximate quantiles of the ids, with straight
    lines between them: they only set sizes, so any error in them leaves the order exact.
    """
    t = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    knots, n = t.agg(F.percentile_approx("id", [i / KNOTS for i in range(KNOTS + 1)], 2000), F.count(F.lit(1))).first()
    knots = sorted(set(knots or [0]))
    per_knot = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS) // max(1, len(knots) - 1))
    at = F.array(*[F.lit(x).cast("long") for x in knots])
    below = F.least(F.size(F.filter(at, lambda x: x <= F.col("id"))), F.lit(max(1, len(knots) - 1)))
    k = F.greatest(below, F.lit(1))
    lo, hi = F.get(at, k - 1).cast("double"), F.get(at, F.least(k, F.lit(len(knots) - 1))).cast("double")
    inside = F.when(hi > lo, F.floor((F.col("id").cast("double") - lo) / (hi - lo) * per_knot)).otherwise(F.lit(0))
    inside = F.greatest(F.lit(0), F.least(F.lit(per_knot - 1), inside))
    t = t.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(k * per_knot + inside).cast("long"))
    heads = t.groupBy("bucket").agg(F.max("id").alias("head"))  # at most MAX_BUCKETS and a few rows
    down = W.orderBy(F.desc("bucket"))
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    heads = heads.select(F.col("bucket").alias("b"), "head", "to")
    t = t.join(F.broadcast(heads), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("to").isNull(), F.array("bucket")).otherwise(F.array("bucket", "to"))
    out = t.select("id", "text", F.posexplode(places).alias("pos", "bucket")).select("id", "text", "bucket", (F.col("pos") == 1).alias("is_copy"))
    return out.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), "bucket")


def op5_bottom_k_sketch(spark, sf_dir: str) -> DataFrame:
    rows = next_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("tie", F.xxhash64("text"))
    order = W.partitionBy("bucket").orderBy("is_copy", F.desc_nulls_last("id"), "tie")
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("sketch", bottom_k(F.col("words"))).drop("words")
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("not is_copy")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", (F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substring("next", F.lit(1), F.col("half"))))
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", words(F.col("edited")).alias("words"))
    rows = rows.select("id", "n_chars", "edited_sha256", "sketch", "next_sketch", bottom_k(F.col("words")).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )
