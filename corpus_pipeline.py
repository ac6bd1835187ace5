"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; the last one returns the packed pieces. Every stage works on all that its
predecessor kept; its result is written as Parquet and read again as the next one's docs.

Defined results of all stages: a row with a null doc_id is a document like any other, after
all others where ids order; rows that share a doc_id with different texts are each judged by
their own text; null text counts as empty; extra columns of docs are left out, whatever
their names; an empty table gives an empty one. Each stage says what else it defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.ngram_join import one_of_each
from alphaloom.llm.packing import pack_documents
from alphaloom.llm.pii import pseudonymise, run_key
from alphaloom.llm.quality_rules import boilerplate_lines, passed
from alphaloom.llm.shared import drop_scratch, materialise, scratch_scope, table
from alphaloom.llm.suffix_dedup import remove_repeats
from alphaloom.session import share_code

#: Words in a shingle and percent of shingles shared of the near-duplicate stage; op9's query has its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that are boilerplate on their host go from the rest. Both go by one count over all the input.

    Null and empty texts have no words and go; a null source is one host; repeated rows count as
    one document and all stay or go; very long texts are judged whole; a line exactly at a limit stays.
    """
    common = materialise(boilerplate_lines(docs), "boilerplate")
    return _columns(passed(docs.select(*COLUMNS), common=common))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80 % of the shingles of five words) stays: the one with the smallest id.

    Texts without words are no duplicates, unless their rows repeat an id: of rows equal in id and text one stays. Of equal texts
    the smallest id stays, a null id only if no other has the text; exactly 80 % is a duplicate.
    """
    return _columns(one_of_each(docs.select(*COLUMNS), NEAR_WIDTH, NEAR_PERCENT))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds go; a document of which no word is left goes.

    Null, empty and blank texts go; a row with a null id loses nothing and removes nothing elsewhere; rows of one
    id remove nothing from each other; a character cut in part goes as a whole.
    """
    left = remove_repeats(docs, carry=("doc_id", "lang", "source")).withColumnRenamed("kept", "text")
    return _columns(left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms under one key for the run, so equal values stay linked.

    Every row stays; null and empty texts stay as they are; repeated rows get equal results.
    """
    return _columns(pseudonymise(docs.select(*COLUMNS), run_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset, of every row.

    Null and empty texts are the end id alone; a long text is cut into whole windows and a rest; repeated rows are packed each.
    """
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(share_code(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _ready(quality_stage)),
    ("ngram_jaccard", _ready(near_duplicate_stage)),
    ("suffix_dedup", _ready(passage_stage)),
    ("pii", _ready(pii_stage)),
    ("packing", _ready(packing_stage)),
]

#: SQL can't express the exact tokeniser or the suffix sort; tests/llm holds every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one. Scratch tables of a stage go once its result is written, a stage's result once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch_scope() as scope:
            docs = materialise(stage(spark, docs, sf_dir), name)
            scope.keep(docs)
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
