"""A training-data pipeline over ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of ``docs``.

What every stage does with odd input:
* null text counts as empty text, and stays null where the document is kept; empty texts are scored,
  link with nothing, hold no passage and no secret, and are packed as the end id alone;
* texts are read whole, however long;
* rows without ``doc_id`` pass the first, third and fourth stage like others;
* repeated rows: all are scored alike; of equal or nearly equal texts the smallest id stays after the
  second stage; rows that share an id stay or go together;
* empty ``documents`` give no rows; empty ``labels`` give a model that says 0.5 for every text, so
  all stay; an empty ``benchmark`` removes nothing;
* extra columns of ``documents`` are handed on unchanged, ``n_chars`` follows a masked text; stages
  compute in columns whose names begin with two underscores, or apart from the extra columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import curve, rtree, rules, secrets, tiling
from leadlens.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = rules.quality_model(spark, docs, sf_dir)
    name = "__quality"
    return rules.score(docs, model, name=name).where(F.col(name) >= rules.THRESHOLD).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return rtree.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return curve.piece_digests(curve.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

#: Trained models, tokenizer files and hashed curves have no SQL; tests/llm hold the brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
