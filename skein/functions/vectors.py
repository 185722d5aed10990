"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero or missing vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """Cosine similarity to one fixed vector, whose length is divided out once."""
    norm = sum(float(x) ** 2 for x in vector) ** 0.5
    return F.try_divide(dot(a, literal(vector)), F.sqrt(dot(a, a)) * norm) if norm else F.lit(None).cast("double")


def to_text(vector: Column) -> Column:
    """``[v,...]`` with ten decimals, halves to the even one."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.10f", F.bround(x.cast("double"), 10))), ","), F.lit("]"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean): all rows count; the mean is taken over present vectors, partial sums before the shuffle.

    Rows are counted at the first place of their vectors, and those without a place by themselves; a key without any vector has no mean.
    """
    cells = df.select(key, F.posexplode_outer(vector).alias("pos", "value")).groupBy(key, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"), F.count(F.lit(1)).alias("rows"))
    placed = F.when(F.col("pos").isNotNull(), F.struct("pos", "value"))
    counted = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("rows")).otherwise(0))
    means = cells.groupBy(key).agg(counted.alias("n"), F.array_sort(F.collect_list(placed)).alias("cells"))
    return means.select(key, "n", F.when(F.size("cells") > 0, F.transform("cells", lambda c: c["value"])).alias("mean"))
