"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised text, Spark's external sort places equal texts next to each other,
and the window over them compares neighbours in full and retains the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, materialise, partitions

#: Characters of a text in its range key; the key's hash tells texts with one prefix apart, so that the splitters which
#: reach the driver stay small however long the texts are.
PREFIX = 24


def normalised(col) -> F.Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), f"{SPACE}+", " ")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. With ``only_kept``: the rows of docs that stay, as they are.

    Texts are equal when identical after ``normalised``. Null text counts as empty. Of equal texts the row with the
    smallest id stays; of rows that repeat that id too, exactly one. Null ids come last: a group of only null ids keeps
    one row and has a null keep_id. Empty tables give empty results, and other columns of docs are neither read nor
    returned, whatever their names.

    A text that more than 1/(2n) of the rows share (n: shuffle partitions; there are fewer than 2n such texts) is
    salted by id, so that no task gets all of its copies; the runs of its salts, at most 4n in all, are then compared
    by full text again and joined by broadcast.
    """
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t"))
    if only_kept:
        base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col], F.lit(0)).alias("_rest"))
    base = base.withColumn("_h", F.xxhash64("_t"))
    most = max(16, docs.count() // (2 * n))
    # fewer than 2n rows: each stands for more than 1/(2n) of all
    salts = materialise(base.groupBy("_h").count().where(F.col("count") > most).select("_h", F.ceil(F.col("count") / most).alias("_salts")), "heavy-texts")
    heavy = not salts.isEmpty()
    if heavy:
        base = base.join(F.broadcast(salts), "_h", "left")
        base = base.withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("_id"), F.col("_salts")))).drop("_salts")
    else:
        base = base.withColumn("_salt", F.lit(-1).cast("long"))
    # the range partitioning satisfies the windows' clustering, and the first window's sort serves both
    key = ["_p", "_h", "_salt"] if heavy else ["_p", "_h"]
    dealt = base.withColumn("_p", F.substring("_t", 1, PREFIX)).repartitionByRange(n, *key)
    if only_kept:
        # the text travels once: it is normalised again on the other side
        dealt = base.withColumn("_p", F.substring("_t", 1, PREFIX)).drop("_t").repartitionByRange(n, *key).withColumn("_t", normalised(F.col("_text")))
    run = Window.partitionBy(*key, "_t")
    runs = dealt.withColumn("_head", F.row_number().over(run.orderBy(F.col("_id").asc_nulls_last())) == 1)
    carried = ["_text", "_rest"] if only_kept else []
    runs = runs.select(*carried, "_id", "_salt", F.sha2("_t", 256).alias("text_sha256"), F.min("_id").over(run).alias("_min"), F.count(F.lit(1)).over(run).alias("_n"), "_head", "_t")

    def rows(kept: DataFrame) -> DataFrame:
        return kept.select(*[(F.col("_text") if c == text_col else F.col(f"_rest.c{k}")).alias(c) for k, c in enumerate(docs.columns)])

    if not heavy and only_kept:
        return rows(runs.where("_head"))
    if not heavy:
        return runs.select(F.col("_id").alias(id_col), F.col("_min").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_head").alias("kept"), "text_sha256")
    runs = materialise(runs.withColumn("_t", F.when(F.col("_head") & (F.col("_salt") >= 0), F.col("_t"))), "content-sort")
    same = Window.partitionBy("_t")
    stitched = runs.where(F.col("_t").isNotNull()).select(
        "text_sha256", "_salt",
        F.min("_min").over(same).alias("_keep"),
        F.sum("_n").over(same).alias("_size"),
        (F.row_number().over(same.orderBy(F.col("_min").asc_nulls_last(), "_salt")) == 1).alias("_wins"),
    )
    whole = runs.drop("_t").join(F.broadcast(stitched), ["text_sha256", "_salt"], "left")
    if only_kept:
        return rows(whole.where(F.col("_head") & F.coalesce("_wins", F.lit(True))))
    return whole.select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_min").alias("keep_id"),
        F.coalesce("_size", "_n").alias("group_size"),
        (F.col("_head") & F.coalesce("_wins", F.lit(True))).alias("kept"),
        "text_sha256",
    )
