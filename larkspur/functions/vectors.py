"""Distances of array<float> columns and points in well-known text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A query vector; folded into the plan as a constant."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


def negative_inner(a: Column, b: Column) -> Column:
    return -dot(a, b)


def embedder(spark: SparkSession, embed: Callable[[list[str]], Sequence[Sequence[float]]], name: str = "ai_embed") -> None:
    """Make a function of texts that SQL and ``F.call_function`` know as ``name``. ``embed`` gets
    the texts of an Arrow batch, without NULLs, and gives a vector for each."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if len(known):
            out[known.index] = pd.Series([list(map(float, v)) for v in embed(known.tolist())], index=known.index, dtype=object)
        return out

    spark.udf.register(name, run)


POINT = r"^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$"


def point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def st_x(p: Column) -> Column:
    return F.regexp_extract(p, POINT, 1).try_cast("double")


def st_y(p: Column) -> Column:
    return F.regexp_extract(p, POINT, 2).try_cast("double")


def st_distance(a: Column, b: Column) -> Column:
    return F.sqrt((st_x(a) - st_x(b)) * (st_x(a) - st_x(b)) + (st_y(a) - st_y(b)) * (st_y(a) - st_y(b)))


def st_geomfromtext(text: Column) -> Column:
    """The text if it is a point, else NULL."""
    return F.when(text.rlike(POINT), text)
