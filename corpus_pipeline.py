"""A training corpus from documents, in stages that each read what the stage before has written.

Language identification, line deduplication, near-copy removal, source mixing, byte-level
encoding. All stages but the last return the columns of documents, whatever their names, and
give an empty table for an empty one. Repeated rows, with equal id and text, stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.storage import step_scratch, table
from strandloom.llm import bpe, jaccard, language, line_chunks, mixing

#: Parameters of the stages.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
MIX_ENTROPY, MIX_PASSES = 0.97, 1.5
RANKS = "byte_bpe_50k.tiktoken"


def _bundled(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others as one named ``others``, so that no name of theirs meets one that an operator adds."""
    return docs.select(*used, F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in used]).alias("others"))


def _unbundled(out: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` in their order, from what ``_bundled`` has made of them."""
    return out.select(*[F.col(c) if c in used else F.col("others")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without text or letters go.

    Ties of languages go as identify_languages says; a row without an id is judged by its text like others.
    """
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines and passages that an earlier place holds; those of which nothing is left go.

    n_chars becomes the length of the text that is left. Of equal places the one of the smallest id, then the first line, stays; rows
    without an id stay as they are, and rows that had nothing to lose stay even if their text is null or empty.
    """
    left = line_chunks.dedup_lines(_bundled(docs, "doc_id", "text"), passages=True).filter("n_lines_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    left = _unbundled(left, docs, "doc_id", "text")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Rows without an id or words stay, null texts among them.
    """
    return jaccard.drop_near_copies(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document at least once, those of small sources more often.

    A null source is one like others; rows without words are used once. Ties of ranks go by id.
    """
    used = ("doc_id", "source", "text")
    return _unbundled(mixing.mix_sources(_bundled(docs, *used), MIX_ENTROPY, MIX_PASSES), docs, *used)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each use of a document, with their digests: a row for each row, null texts with no ids; columns as encode_documents says."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL can express neither the automata of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next.

    Tables that a stage has written for itself are deleted once its result stands.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with step_scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
