"""A corpus pipeline over the training-data operators.

``run`` applies STAGES to the documents table. Each stage's result is written as
Parquet to the shared folder and read again as the next stage's documents, so a
lost executor costs a part of one stage. The stages before the last return the
columns of documents; every stage works on all that the one before it kept.

Defined cases: a row is a document, also one that repeats a doc_id or has none;
of near duplicates, the row with the smallest doc_id stays (a null one last, the
first row among equal ids). A null or empty text fails the quality rules. A null
language or source is a value of its own. Columns other than those of documents
are dropped by the first stage. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.line_dedup import line_dedup
from tabsmith.llm.ngram_join import ngram_join
from tabsmith.llm.packing import LIMITS, PROMPT, pack_documents
from tabsmith.llm.quality_classifier import classify
from tabsmith.llm.quality_rules import quality_rules
from tabsmith.llm.store import documents, save, table

#: No SQL: the stages estimate, learn and tokenize. tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not."""
    return classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, by its file and place there, the same whenever the files are read."""
    docs = docs.select(*COLUMNS)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:               # no file beneath: make some
        return _numbered(save(docs, "pipeline-rows"))
    files = save(placed.select("file").distinct().withColumn("number", F.monotonically_increasing_id()), "pipeline-files")
    # a row a file; a file's number has a partition's in its upper bits, a row's place takes fewer than 2^32
    numbers = files.select("file", (F.row_number().over(Window.orderBy("number")) - 1).cast("long").alias("number"))
    return placed.join(F.broadcast(save(numbers, "pipeline-files")), "file").select(
        *COLUMNS, (F.shiftleft("number", 32) + F.col("at")).alias("row"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    # the join is of rows, so that neither repeated nor missing ids change what is a document
    rows = _numbered(docs)
    groups = ngram_join(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    many = save(groups.where("row <> group").select("group").distinct(), "join-groups")     # groups of more than one row
    members = save(groups.join(many, "group").join(rows.select("row", "doc_id"), "row"), "join-members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = members.groupBy("group").agg(F.min(order)["row"].alias("stays"))
    gone = save(members.join(first, "group").where("row <> stays").select(F.col("row").alias("gone")), "join-gone")
    return rows.join(gone, F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    import public_tokenizers
    # the workers that packed serve the next stages and runs too, so they keep nothing
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), limits=LIMITS, prompt=PROMPT,
                            cache_units=250_000, keep_cache=False)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
