"""Exact deduplication by skew-safe combining (DataFrame functions only).

Rows are equal when their texts are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Three combining stages, each keyed by the digest *and the whole
normalised text*, so every merge compares full content:

1. locally, in the map-side half of the aggregation: one row per text and task;
2. per (digest, text, salt): a text that holds a third of all rows meets in ``salts`` tasks;
3. per (digest, text): at most ``salts`` winners of a text meet.

Documents then learn their group's winner through a join on the digest; the winners are written
first, so adaptive execution can split the rows of a hot digest over tasks. The join is guarded:
should two different texts ever share a digest, the query fails instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fewer, materialise, numbered

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: 2**65: room for one id (2**64 values and null) below the text length in the ranking number.
_BASE = "cast(36893488147419103232 as decimal(20,0))"
_TOP = "cast(9223372036854775808 as decimal(20,0))"


def normalised(text: Column) -> Column:
    """``text`` (null: empty) without ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _rank() -> Column:
    """Longer original text first, then the smaller id; a null id comes after all others."""
    return F.expr(
        f"cast(length * {_BASE} as decimal(38,0)) + "
        f"coalesce({_TOP} - id, cast(0 as decimal(20,0)))")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: digest (binary), group_size, keep_id, keep_length."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.length(text).alias("length"),
                        normalised(text).alias("content"))
            .select(F.unhex(F.sha2("content", 256)).alias("digest"), "content",
                    F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), _rank().alias("rank")))
    salted = rows.groupBy("digest", "content", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
    winners = salted.groupBy("digest", "content").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    one = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("n").alias("group_size"), F.max("rank").alias("rank"))
    checked = one.select(
        "digest", "group_size", "rank",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256 digest")).cast("int"))
        .alias("collision"))
    return (checked.where("collision is null")
            .withColumn("keep_length", F.expr(f"cast(floor(rank / {_BASE}) as long)"))
            .withColumn("rest", F.expr(f"cast(rank - keep_length * {_BASE} as decimal(20,0))"))
            .select("digest", "group_size", "keep_length",
                    F.expr(f"case when rest > 0 then cast({_TOP} - rest as long) end").alias("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Decision for every row, dropped ones too.

    Returns (id, keep_id, group_size, kept, text_sha256). Null text counts as empty; empty
    texts form one group. A null id ranks after every other id. Rows repeated with the same
    id and an equal text of equal length count one by one in ``group_size``, and exactly one
    of them is kept. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.length(text).cast("long").alias("length"),
                       F.unhex(F.sha2(normalised(text), 256)).alias("digest"))
    # rows that nothing tells apart, counted; opened again after the join
    alike = rows.groupBy("id", "length", "digest").agg(F.count(F.lit(1)).alias("alike"))
    joined = alike.join(materialise(groups(docs, id_col, text_col, salts), "winners"), "digest")
    return (joined.select("*", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int"))).alias("ordinal"))
            .select("id", "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
                     & (F.col("ordinal") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; edge cases as :func:`exact_dedup`.

    Columns may have any names. The join's keys hold the row's id beside the digest, so copies of a
    text are spread over its tasks. The result has a partition for every four of the join's: each file that
    a task opens on a local file system starts a child process, which counts the JVM's memory twice meanwhile.
    """
    own = numbered(docs)
    key = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    # plain equality on columns without nulls: the window below then needs no exchange of its own
    keys = ["digest", "length", "known", "id"]
    found = groups(docs, id_col, text_col, salts).select(
        "digest", F.col("keep_length").alias("length"), F.col("keep_id").isNotNull().alias("known"),
        F.coalesce("keep_id", F.lit(0)).alias("id"))
    own = own.withColumns({"digest": F.unhex(F.sha2(normalised(text), 256)), "length": F.length(text).cast("long"),
                           "known": key.isNotNull(), "id": F.coalesce(key, F.lit(0))})
    one = Window.partitionBy(*keys).orderBy(F.lit(1))
    return fewer(own.join(found, keys).withColumn("place", F.row_number().over(one)).where("place = 1")
                 .select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns))
