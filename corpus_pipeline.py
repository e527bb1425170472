"""The corpus pipeline: four stages over documents, each written as Parquet and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. The rules of each stage for
nulls, empty texts and repeated rows are those of its operator.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpe import bpe_encode_placed
from tidegauge.llm.common import scratch_path, table
from tidegauge.llm.minhash import drop_near_duplicates
from tidegauge.llm.mixing import mix
from tidegauge.llm.toxicity import NO_LEXEMES, drop_toxic, fit_lexemes


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject; without a table of labels it knows English words only."""
    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return drop_toxic(docs, lexemes=NO_LEXEMES)
    return drop_toxic(docs, lexemes=fit_lexemes(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order under the tempered schedule, every one at least once."""
    return mix(docs)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, read from files, with position: the place of each row, from 0, in the order the files were written in.

    Spark reads large files first; the order is that of the numbers in the files' names and, within a file, of its rows.
    """
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file__"), F.col("_metadata.row_index").alias("__row__"))
    sizes = [(r[0], r[1]) for r in rows.groupBy("__file__").agg(F.count("*")).collect()]

    def written(path: str) -> tuple:
        name = path.rsplit("/", 1)[-1]
        return [int(x) for x in re.findall(r"^part-(\d+)|\.?c(\d+)\.", name) for x in x if x], name

    starts, at = [], 0
    for path, n in sorted(sizes, key=lambda x: written(x[0])):
        starts.append((path, at))
        at += n
    begin = F.broadcast(docs.sparkSession.createDataFrame(starts, "__of__ string, __start__ bigint"))
    joined = rows.join(begin, F.col("__file__") == F.col("__of__"))
    return joined.select("doc_id", "text", (F.col("__start__") + F.col("__row__")).alias("position"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and position, the rank in training order, by which the rows are sorted.

    docs has to be read from the files that mixing wrote, of which the order is recovered."""
    return bpe_encode_placed(placed(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: The grammar, MinHash over byte hashes, and byte-pair merging have no SQL form; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
