"""A training corpus from documents: five stages, each on all that the one before it has kept.

Each stage is f(spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Rows with a null doc_id stay wherever keys decide; a null text counts as empty; repeated rows stay repeated rows, until
near-duplicates go (rows that share a key go or stay together); an empty table gives an empty table. doc_id has to be
of whole numbers. Extra columns may have any names, and come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.llm.bpe import encode_documents
from leafstack.llm.common import cut, drop_cut, table
from leafstack.llm.minhash import keep_one
from leafstack.llm.mixing import copies, mix
from leafstack.llm.quality import judge
from leafstack.llm.queries import MIX_WEIGHTS
from leafstack.llm.substring import remove_repeats

#: Repeated passages of at least so many words go.
PASSAGE = 50
#: The mixture holds nine tenths of the tokens, no document twice.
PART, EPOCHS, SEED = (9, 10), 1, "pipeline-1"


#: Columns of documents that stages work with.
ROLES = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """A stage that keeps the columns of docs: those it doesn't work with have names of their own meanwhile, so that none is taken for an operator's."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c if c in ROLES else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)]), sf_dir)
        return out.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return judge(docs, table(spark, sf_dir, "labels")).filter("accepted")


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id."""
    return keep_one(docs)


@apart
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long passages that an earlier one has; n_chars follows."""
    left = remove_repeats(docs, PASSAGE)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


@apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture."""
    domain = (F.regexp_extract("source", r"(\d+)$", 1).try_cast("long") % 4).cast("string")
    return copies(mix(docs, domain, MIX_WEIGHTS, PART, EPOCHS, SEED), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encode", encode)]
#: BagMinHash, the classifier and the token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
