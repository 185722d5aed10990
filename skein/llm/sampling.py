"""A bounded sample of labelled documents, by a hash of doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A label's rows are ranked in so many shares first, so that no task ranks all rows of a frequent label.
SHARES = 64


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows of each label of ``rows`` (doc_id, label), those of the smallest hashes of doc_id.

    An id stands for all its rows of the label, and they count as many; an id with more than ``most`` of them is in no
    sample, nor is a null id.
    """
    ids = rows.filter("doc_id is not null").groupBy("doc_id", label).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") <= most)
    ids = ids.withColumn("hash", F.xxhash64("doc_id")).withColumn("share", F.pmod("hash", F.lit(SHARES)))
    for keys in ([label, "share"], [label]):
        order = Window.partitionBy(*keys).orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ids = ids.withColumn("n", F.sum("rows").over(order)).filter(F.col("n") <= most)
    return ids.select("doc_id", label)
