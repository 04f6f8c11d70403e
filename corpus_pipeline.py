"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of packed sequences.

In every stage a null text is an empty one, rows with a null id are rows like others, an empty table gives an empty result, and
further columns are carried along whatever their names. Repeated rows and ties are settled as the stages say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm.common import stash, table
from crosspanel.llm.exact_dedup import exact_dedup
from crosspanel.llm.mixing import mix
from crosspanel.llm.near_text import near_text_dedup
from crosspanel.llm.packing import pack
from crosspanel.llm.quality_lm import keep_good
from crosspanel.llm.selection import after_exact, after_mix, after_near

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text doesn't reject. Equal texts of one language share their verdict, so repeated rows stay or go together; an empty text is kept or rejected by its language's limit like others."""
    return keep_good(docs, table(spark, sf_dir, "labels"), TOKENIZER)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest with its white space, then the smallest id; of rows that share an id, told apart by all columns."""
    return after_exact(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of texts that share 0.8 or more of their five-word shingles.

    Texts without words are one component. Null ids are not smallest; a component of null ids alone keeps its rows.
    """
    return after_near(docs, near_text_dedup(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; some leave, some come up to three times. A null source is a source; rows of one id and source share their mean."""
    return after_mix(docs, mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; repeated rows are packed each."""
    return pack(docs, TOKENIZER)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near), ("mixing", mixed), ("packing", packed)]
#: Language-model scoring, XXH64 and tokenising can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
