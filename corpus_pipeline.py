"""From raw documents to token ids: reject toxic texts, drop near-duplicates, cut repeated passages, mix sources, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Its result is
written as Parquet and read again as the next stage's documents; that also is the moment when the
stage's own intermediate tables are no longer needed. Stages may as well be chained without writing.

For all stages: a null text counts as empty; texts of any length are worked on whole; rows that repeat another one, with its id or
without, are rows of their own unless a stage says otherwise; rows with a null id are kept as a stage says; further columns of ``docs``, whatever
their names, are carried along untouched (the last stage returns its own columns only); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import scratch, toxicity
from cartoloom.llm.minhash_dedup import near_duplicates
from cartoloom.llm.mixing import mix_sources
from cartoloom.llm.pieces import encode_pieces
from cartoloom.llm.queries import tokenizer_file
from cartoloom.llm.suffix_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """Note on the result which intermediate tables it reads; the stage that gets the written result deletes them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.settle(docs, "doc_id")
        with scratch.scope() as folders:
            out = work(spark, docs, sf_dir)
        return scratch.marked(out, folders, "doc_id")

    run.__doc__, run.__name__ = work.__doc__, work.__name__
    return run


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    A score of exactly the threshold is toxic. Null texts score as empty ones; equal texts score alike, so repeated rows stay or go
    together; null ids are scored like others. Without toxic labels nothing is rejected; with toxic labels only, everything is.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, rows=True).where("predicted = 0")
    return scored.select(*(c if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates.

    Rows without id cannot be grouped and stay, as do documents without words, which link with nothing. All rows of the id that is kept stay.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    known = docs.join(kept.hint("merge"), docs["doc_id"] == kept["kept_id"], "left_semi")
    return known.unionByName(docs.where("doc_id is null"))


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document or place holds; documents left empty stay, as empty ones.

    Earlier is the smaller id. Rows with a null id have no place in the order: they stay whole and remove nothing. Rows that repeat an id are one
    document: they do not remove each other, and a range removed in one is removed in all. ``n_chars`` is counted anew; a null text becomes an empty one.
    """
    cut = remove_repeats(docs, rows=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


@_stage
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it (0, 1 or 2 rows).

    Null sources are a source of their own, listed last. Which rows a source repeats is seeded; rows alike in all columns count one by one.
    """
    mixed = mix_sources(docs, rows=True).where("repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row: ``doc_id, n_pieces, round_trip, ids``. Null and empty texts have no ids; null and repeated ids are passed through."""
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("mix_sources", mix_to_weights),
    ("sentencepiece", encode),
]

#: Hash signatures, suffix order and the lattice have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: list[str] = []
    for name, work in STAGES:
        path = scratch.new_path(spark, name)
        work(spark, docs, sf_dir).write.parquet(path)
        for old in held:
            scratch.release([(spark, old)])
        held, docs = [path], spark.read.parquet(path)
    return docs
