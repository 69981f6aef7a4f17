"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents, and columns of any other names as they came.  Rows without
doc_id pass the stages that decide by id.  Null and empty texts are copies of one another, so one document of them stays where the
classifier keeps it; of repeated rows one stays; texts of any length count whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, decontamination, line_dedup, near_copies, quality
from framelake.llm._common import materialize, read_table
from framelake.llm.queries import tokenizer_path


def _apart(docs: DataFrame) -> DataFrame:
    """Ids and texts, with the rows' other columns beside them, out of reach of the names that operators add; a row has its text once."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("own"))


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return rows.select(*("text" if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows of its input, predicts to be good."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return _together(quality.score(_apart(docs), model).where("predicted = 1"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least two others share, except where the last of them keeps these."""
    return _together(line_dedup.dedup_lines(spark, _apart(docs)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that with the smallest doc_id."""
    return near_copies.keep_one(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.remove(spark, docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), short_share=decontamination.SHORT_SHARE)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text decoded from them."""
    return bpe.encode_decode(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "ids", "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-copy dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: The classifier, near copies and BPE are beyond SQL; the stages are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written output of the one before."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(spark, docs, "stage-" + name.split()[0].lower())
    return docs
