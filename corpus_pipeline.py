"""Five corpus stages from raw documents to token ids, each over all that the one before it kept.

What a stage returns must be written before the next stage is called, as run() does. In every stage columns of any name pass as they are, very long texts are handled whole, and an empty table gives an
empty one. What null and empty texts, null ids and repeated rows lead to is said at each stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, line_dedup, neardup, quality_rules
from tidemark.llm.common import discard, discard_written, settle, table, written
from tidemark.llm.queries import RANK_FILE

#: Tables beside their results that stages have written; a stage deletes those of the stages before it.
_left_over: list[str] = []


def _own_tables(stage):
    """A stage whose intermediate tables go when the next one begins, as what it returned has been written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_written(spark, _left_over)
        before = set(written())
        out = stage(spark, docs, sf_dir)
        _left_over[:] = [name for name in written() if name not in before]
        return out

    return run


#: What counts as a copy: five words, similarity 0.8.
COPIES = neardup.plan(shingle=5, num=4, den=5)


@_own_tables
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go: null and empty texts among them. Repeated rows stay or go together; a null doc_id is judged like any."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


@_own_tables
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; every document stays, also null and repeated ones. One document of each group of copies tells what is spread."""
    single = settle(neardup.deduplicate(docs, COPIES).select("text", "source", "doc_id"))
    return line_dedup.remove_boilerplate(docs, among=single)


@_own_tables
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id: five words, similarity 0.8. Wordless texts are linked with nothing, rows without a doc_id stay."""
    return neardup.deduplicate(docs, COPIES)


@_own_tables
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts have none, and repeated rows go together."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@_own_tables
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded texts; null and empty texts have no ids."""
    return bpe.digest(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]

#: The stages hold a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again by the next, and deleted once that has written its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = settle(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
