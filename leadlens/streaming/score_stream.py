"""Score arriving lead files with fixed (training-time) statistics or a saved model.

A stream is stateless here: the batch median / mode / moments of the scoring app are not
available per micro-batch, so imputation and scaling use statistics captured once from a
reference table, or those inside a trained pipeline. Files are picked up with
``trigger(availableNow=True)`` and progress is kept in a checkpoint, so a restarted job
resumes where it stopped and a lost executor only re-runs its micro-batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.features import require_columns
from leadlens.operators.models import model_scores
from leadlens.operators.scoring import frozen_scores, scorer_statistics
from leadlens.sources.leads_csv import csv_schema, nan_to_null, snake


def capture_stats(reference: DataFrame) -> Row:
    """Training-time statistics (one small row)."""
    return scorer_statistics(reference).first()


def score_with_stats(df: DataFrame, stats: Row) -> DataFrame:
    """The frozen scorer with literal statistics: a pure per-row projection."""
    typed = F.struct(*[_typed(stats[k], "string" if k == "c" else "double").alias(k) for k in ("m", "c", "mean", "sd")])
    return frozen_scores(df, typed)


def _typed(part: Row, kind: str) -> Column:
    return F.struct(*[F.lit(v).cast(kind).alias(k) for k, v in part.asDict().items()])


def lead_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet", header: list[str] | None = None) -> DataFrame:
    """Arriving lead files as a stream of lead columns. CSV columns go by their header names, as
    in ``read_leads``: ``header`` is the files' header line (default: that of a file already
    there); a file with another header fails its micro-batch instead of being misread."""
    if fmt == "parquet":
        src = spark.readStream.schema(S.LEAD_SCHEMA).parquet(source_dir)
    else:
        names = header or spark.read.option("header", True).csv(source_dir).columns
        src = (spark.readStream.schema(csv_schema(names)).option("header", True)
               .option("enforceSchema", False).csv(source_dir))
        src = src.select(*[F.col(f"`{c}`").alias(snake(c)) for c in src.columns])
    require_columns(src)
    return nan_to_null(src)


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         scorer: Row | PipelineModel, fmt: str = "parquet", header: list[str] | None = None):
    """Start the stream (available files now, then stop); returns the StreamingQuery. ``scorer``:
    captured statistics (frozen scorer) or a trained pipeline."""
    src = lead_stream(spark, source_dir, fmt, header)
    scored = model_scores(scorer, src) if isinstance(scorer, PipelineModel) else score_with_stats(src, scorer)
    return (scored.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
