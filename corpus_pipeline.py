"""The corpus pipeline: rules, line dedup, near-dedup, mixing, encoding, each stage over all that the one before kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.bpe import encode_texts
from trackweave.llm.common import c, drop_saved, lookup, recorded, saved
from trackweave.llm.linedup import line_dedup
from trackweave.llm.mixing import Mixture, mix_sources
from trackweave.llm.neardup import near_duplicates
from trackweave.llm.quality import quality_rules
from trackweave.llm.queries import DOMAIN

#: Nine tenths of the tokens, every leaf alike: leaves that have less give all, and the largest one gives up the rest.
MIX = Mixture(percent=90, epochs=1)

#: Ids of removed documents broadcast at most.
BROADCAST_IDS = 1_000_000


#: By session, folder and stage: the tables that its last results read.
_left: dict[tuple, list[str]] = {}


def stage(number: int):
    """Marks a stage. Once a later stage of the same session and folder begins, the results of the earlier ones have been written
    (each is the next one's docs), so it drops the tables that they read. A stage never drops what its own calls have left."""

    def mark(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            run = (str(spark._jsparkSession.sessionUUID()), sf_dir)
            for k in range(number):
                for path in _left.pop((*run, k), []):
                    drop_saved(spark, path)
            with recorded(_left.setdefault((*run, number), [])):
                return f(spark, docs, sf_dir)

        return run_stage

    return mark


@stage(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    judged = quality_rules(docs)
    return judged.where(c(judged.columns[-1])["kept"]).select(*[c(x) for x in docs.columns])


@stage(1)
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of lines; n_chars follows the text."""
    clean = line_dedup(docs).select(*[c(x) for x in docs.columns])
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@stage(2)
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    gone = saved(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return lookup(docs, gone, "doc_id", "left_anti", BROADCAST_IDS).select(*[c(x) for x in docs.columns])


@stage(3)
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture reads it."""
    mixed = mix_sources(docs, F.expr(DOMAIN), mix=MIX)
    times = c(mixed.columns[-1])["epochs"]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), times)) if MIX.epochs > 1 else F.lit(1)
    return mixed.where(times > 0).select(*[c(x) for x in docs.columns], copies.alias("m_copy")).drop("m_copy")


@stage(4)
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("mix_sources", mix_stage),
    ("byte_bpe", encode_stage),
]

#: Near-dedup by components and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, run_stage in STAGES:
        docs = saved(run_stage(spark, docs, sf_dir), name)
    return docs
