"""A fitted embedder as one saved package: feature hashing, IDF and normaliser as a PipelineModel.

Tokens are hashed to places by the first 28 bits of their MD5, which any SQL engine can compute;
the vocabulary is the fixed list of places, so nothing but the document frequencies is learned and
the package stays small whatever the corpus. Applied to later questions it gives vectors of the
same space.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 1024


def _places_sql(text: str, places: int) -> str:
    words = f"filter(split(trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ')), ' '), t -> t <> '')"
    return f"transform({words}, t -> cast(pmod(cast(conv(substring(md5(t), 1, 7), 16, 10) as bigint), {places}) as string))"


def fit_embedder(docs: DataFrame, text: str = "text", places: int = PLACES) -> PipelineModel:
    """The embedder of a corpus; it adds ``vec`` to any table with a ``text`` column."""
    spark = docs.sparkSession
    stages = [SQLTransformer(statement=f"SELECT *, {_places_sql(text, places)} AS __places FROM __THIS__"),
              _counts(spark, places), IDF(inputCol="__tf", outputCol="__weighted"),
              Normalizer(inputCol="__weighted", outputCol="vec", p=2.0),
              SQLTransformer(statement="SELECT * EXCEPT (__places, __tf, __weighted) FROM __THIS__")]
    return Pipeline(stages=stages).fit(docs)


def _counts(spark: SparkSession, places: int) -> CountVectorizerModel:
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(places)], inputCol="__places", outputCol="__tf")
    return model


def save_embedder(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_embedder(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def embed(model: PipelineModel, docs: DataFrame, key: list[str], out: str = "embedding") -> DataFrame:
    """(key..., embedding array<double>)."""
    return model.transform(docs).select(*key, vector_to_array("vec").alias(out))


def weights_long(vectors: DataFrame, key: list[str], vec: str = "embedding") -> DataFrame:
    """(key..., place, weight) of the entries that are not zero."""
    return vectors.select(*key, F.posexplode(vec).alias("place", "weight")).where("weight <> 0")
