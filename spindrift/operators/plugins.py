"""Places where a user's own code goes in: ranking providers, lemmatizers, encoders, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from spindrift.functions import text as T
from spindrift.operators import ranking as R


class RankingProvider(Protocol):
    """Gives candidates (query_id, doc_id, score, retrieval and what it needs) a score and a rank."""

    def rank(self, candidates: DataFrame) -> DataFrame: ...


def ordered(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


class BaselineProvider:
    """The order of the scores that candidates have."""

    def rank(self, candidates: DataFrame) -> DataFrame:
        return ordered(candidates)


class ModelProvider:
    """Predictions of a fitted pipeline, blended with the baseline and the retrieval score; without a model, the baseline's order."""

    def __init__(self, model=None):
        self.model = model

    @classmethod
    def load(cls, path: str) -> ModelProvider:
        from pyspark.ml import PipelineModel

        return cls(PipelineModel.load(path))

    def rank(self, candidates: DataFrame) -> DataFrame:
        if self.model is None:
            return BaselineProvider().rank(candidates)
        predicted = self.model.transform(candidates).select(*candidates.columns, F.coalesce("prediction", F.lit(0.0)).alias("prediction"))
        blended = R.blend(predicted.withColumn("baseline", F.col("score")), ["query_id"])
        return ordered(blended.withColumn("score", F.round("blended", 4)).drop("blended", "baseline", "prediction"))


PROVIDERS: dict[str, Callable[[], RankingProvider]] = {"noop": BaselineProvider, "local_ml": ModelProvider}


def lemmatizer(make: Callable[[], Callable[[str], str]] | None = None, most: int = 100_000) -> Callable[[Column], Column]:
    """A function of a term column. `make` gives a worker its analyser; words are looked up once, `most` of them kept. Without one, lemmas come from endings."""
    if make is None:
        return T.lemma

    @F.pandas_udf(StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse, seen = make(), {}
        for words in batches:
            if len(seen) > most:
                seen.clear()
            for w in words.dropna().unique():
                if w not in seen:
                    seen[w] = analyse(w)
            yield pd.Series([seen.get(w) for w in words], index=words.index, dtype=object)

    return of


def encoder(make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A function of a text column that gives vectors. `make` gives a worker its model, which encodes a batch of texts at a time; nulls are empty texts."""

    @F.pandas_udf(ArrayType(FloatType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())), index=texts.index, dtype=object)

    return of
