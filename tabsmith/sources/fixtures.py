"""Input frames derived from the driver's tables (see FIXTURES.md).

The driver tables have no missing values and no duplicate rows, so the
``dirty_lineitem`` frame injects both with portable expressions; the same
definition is repeated in SQL for the DuckDB oracle. Every frame here reads a
whole table: nothing is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.sources.tables import load_table

# Fixed values of the F2 / F4 fixtures (FIXTURES.md).
NULL_QUANTITY_EVERY = 7
NULL_PRICE_EVERY = 11
SPIKE_PRICE_EVERY = 997
SPIKE_FACTOR = 20
NULL_FLAG_EVERY = 13
DUPLICATE_EVERY = 50


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing cells, price spikes and duplicated rows."""
    li = load_table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    base = li.select(
        "l_orderkey", "l_linenumber",
        F.when(k % NULL_QUANTITY_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % NULL_PRICE_EVERY == 0, F.lit(None).cast("double"))
         .when(k % SPIKE_PRICE_EVERY == 0, F.col("l_extendedprice") * SPIKE_FACTOR)
         .otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax",
        F.when(k % NULL_FLAG_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )
    return base.unionByName(base.filter(k % DUPLICATE_EVERY == 0))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the events table as is."""
    return load_table(spark, sf_dir, "events")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events restricted to its chart inputs: numeric value by event type."""
    return events(spark, sf_dir).select("event_type", "value")


def lineitem_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's measures with the return flag as category (chart inputs)."""
    return load_table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def ml_class_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag")


def ml_class_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.select("event_id", "value", "user_id",
                     F.when(F.col("value") > 50, "hi").otherwise("lo").alias("level"))


def ml_reg_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    y = (3 * F.col("l_quantity") - 10 * F.col("l_discount") + 5
         + 0.001 * (F.col("l_orderkey") % 7))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", y.alias("y"))


def ml_task_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load_table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_retailprice", "p_size")


def labels_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as a query log: (conv_id, turn, query)."""
    conv = load_table(spark, sf_dir, "conversations")
    return (conv.filter(F.col("role") == "user")
                .select("conv_id", "turn", F.col("text").alias("query")))


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per user turn with the next assistant reply as its output.

    (conv_id, turn, query, output); output is NULL when no reply follows.
    The pairing is an equi-join on (conv_id, turn + 1): no window, no skew
    beyond the conversation's own turns.
    """
    conv = load_table(spark, sf_dir, "conversations")
    users = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query"))
    replies = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return users.join(replies, ["conv_id", "turn"], "left")
