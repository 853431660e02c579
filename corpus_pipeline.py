"""A corpus from documents: language ID, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Rows are told apart by a key, not by doc_id: rows without doc_id and rows that share one are documents like any other. Among
equal or similar rows the smallest doc_id stays; rows without doc_id come after all others, and rows of one doc_id in the
order of a hash of their columns. Of fully repeated rows one stays. An empty table gives no rows in any stage; a column of
docs may have any name: the key gets one that no column has, and is known by what its metadata says.

The key, and what a stage writes on its way, stay in the stage's workspace, which is removed when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.tables import remove
from tidewatch.llm import exact_dedup, langid, near_dedup, packing, repeats
from tidewatch.llm.common import materialise, scratch, table, workspace

#: What the metadata of a key says. It goes with the column into Parquet and back.
KEY = {"corpus_pipeline.row_key": True}


def key_of(docs: DataFrame) -> str | None:
    """The column that keyed made, if docs has one."""
    return next((f.name for f in docs.schema if f.metadata == KEY), None)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key, a number that names one row each and follows the order of doc_id (null last); kept if keyed made one before.

    Where every row has a doc_id of its own, that is the key. Otherwise rows are sorted, numbered and written once.
    """
    if key_of(docs):
        return docs
    i, row = F.col("doc_id").cast("long"), _free(docs, "row_key")
    n = docs.groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("i").isNull()).alias("nulls")).first()
    if n["most"] in (None, 1) and not n["nulls"]:
        return docs.select("*", i.alias(row, metadata=KEY))
    ordered = docs.orderBy(i.asc_nulls_last(), F.xxhash64(*docs.columns))
    return materialise(ordered.select("*", F.monotonically_increasing_id().alias(row, metadata=KEY)), "keyed")


def _free(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def _by_row(docs: DataFrame) -> DataFrame:
    """docs for the operators, which take the key as doc_id."""
    return docs.select(F.col(key_of(docs)).alias("doc_id", metadata={}), "text")


def _only(docs: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of docs whose key is in kept's doc_id."""
    row = key_of(docs)
    return docs.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or without a letter) go; lang is filled in where it is null. Rows with any doc_id, or none, are judged by their own text."""
    columns, docs = docs.columns, keyed(docs)
    model = langid.fit(docs.where(~langid.held_out()))
    found = materialise(langid.identify(_by_row(docs), model), "languages").where("lang_pred <> 'und'")
    name, row = _free(docs, "found"), key_of(docs)
    found = found.select(F.col("doc_id").alias(row), F.col("lang_pred").alias(name))
    return docs.join(found, row).withColumn("lang", F.coalesce("lang", name)).select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts (null as empty) stays, that with the smallest doc_id; rows without one only where no other is equal."""
    columns, docs = docs.columns, keyed(docs)
    with exact_dedup.digest_index(spark) as index:
        return _only(docs, index.ingest(_by_row(docs)).where("kept"), columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id. Texts without a word all stay."""
    columns, docs = docs.columns, keyed(docs)
    return _only(docs, near_dedup.near_duplicates(_by_row(docs)).where("kept"), columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a row before (with a smaller doc_id) holds are cut out; n_chars follows the text that is left. No row goes; a null text becomes empty."""
    columns, docs = docs.columns, keyed(docs)
    name, row = _free(docs, "left"), key_of(docs)
    left = repeats.remove_repeats(_by_row(docs), text_too=True).select(F.col("doc_id").alias(row), F.col("kept_text").alias(name))
    cut = docs.drop("text", "n_chars").join(left, row)
    return cut.withColumn("text", F.col(name)).withColumn("n_chars", F.length(name).cast("long")).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens; a null or empty text is one end id, a repeated row is packed as often as it comes."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("repeated_passages", passages), ("best_fit_packing", packed)]
#: Near-dedup, language ID and packing aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = keyed(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with workspace(spark, f"{name}-steps"):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
