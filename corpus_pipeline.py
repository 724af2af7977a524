"""Documents to training tokens: quality rules, line dedup, near-dedup, decontamination, SentencePiece pieces.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return
the columns of documents, whatever these are besides doc_id and text. Every stage takes an empty table, reads texts of any
length whole, and judges repeated rows each for itself, alike where they are equal in id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import common as C
from quillstone.llm import decontaminate, line_dedup, near_dedup, pieces, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go, null and empty texts among them. Labels without an id or a document, and repeated ones, are no cases of their own."""
    return quality.keep_good(docs, C.table(spark, sf_dir, "labels"))


def line_winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier document has go; so does a document that has no other line. Rows that share id and text go or stay together."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, a null id being larger than all. Rows without words all stay."""
    return near_dedup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the question and the answer of a test item go, however many items they hold; those without words, null ones too, stay. Items without id or text match nothing."""
    return decontaminate.without_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, none for a null or empty text, and whether decoding them gives its text. Of segmentations with equal scores one is always taken."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_winnowing", line_winnowing),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: The forest and the search for pieces aren't expressible in SQL; tests compare run() with a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, and the one before it deleted."""
    stages = C.Scratch(spark)
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with C.Scratch.watched():
            docs = stages.keep(stage(spark, docs, sf_dir), name)
        stages.drop_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
