"""What filters remove in every order in which they can be applied: permutation-trie execution.

The orders of k filters form a trie whose nodes, seen as unordered sets of the filters applied so far, are only 2^k
states.  The walk goes depth-first: a state's survivors are its parent's persisted survivors without those that fail one
more filter, a state that was met before is not entered again, and what each filter that is left would remove from the
survivors is counted there, part by part.  A path of k + 1 states is persisted at a time at most.

Defined results: null texts are empty, a null part is the empty string, a verdict that is null counts as passed, repeated
rows count each, an empty table gives no row.  Every part has a row for each order and step, zeros included.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Orders are k! for each part, so that more filters are refused.
MOST_FILTERS = 7
#: What separates words, and the signs that filter D looks for.
SPACES, SIGNS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def text_verdicts(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself: too short (A), repetitive (B), capitals (C), signs (D)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(SIGNS),
    }


def document_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of ``docs`` (doc_id, text, source); ``labels`` are (doc_id, quality, toxic).

    E: the text is that of a smaller doc_id, by SHA-256 over all rows; a null doc_id is neither smaller nor larger.  A
    document is good or toxic if any of its labels says so.  The texts are read once and never shuffled, only digests are.
    """
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *[c.alias(k) for k, c in text_verdicts(F.col("text")).items()])
    seen = stage(seen, "verdicts")
    first = seen.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").drop("_last")
    marks = labels.groupBy(F.col("doc_id").alias("_of")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    copies = seen.join(first, F.col("digest") == F.col("_digest"), "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    marked = copies.join(marks, F.col("doc_id") == F.col("_of"), "left")
    return marked.select("part", "A", "B", "C", "D", "E", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


def walk(rows: DataFrame, filters: Sequence[str], part: str, marks: Sequence[str]) -> DataFrame:
    """(part, state, left, removed, and an array for each mark) of every state of the trie that a part's rows reach.

    ``state`` has the filters applied so far, ``left`` counts their survivors, and ``removed`` has for each filter how many of
    these the edge that applies it removes; the marks' arrays count those of them that have the mark.
    """
    counted: list[DataFrame] = []
    met: set[frozenset[str]] = set()

    # The same columns for every state, so that Spark compiles one plan: what was applied before removes nothing more.
    sums = [F.count_if(F.col(f)).alias(f"removed_{f}") for f in filters] + [F.count_if(F.col(f) & F.col(m)).alias(f"{m}_{f}") for m in marks for f in filters]
    sums.append(F.count(F.lit(1)).alias("left"))
    figures = [F.col("left"), *[F.array(*[f"{c}_{f}" for f in filters]).alias(c) for c in ("removed", *marks)]]

    def counts(alive: DataFrame, state: frozenset[str]) -> DataFrame:
        return alive.groupBy(part).agg(*sums).select(part, F.lit(_name(filters, state)).alias("state"), *figures)

    def enter(state: frozenset[str], alive: DataFrame) -> None:
        met.add(state)
        counted.append(stage(counts(alive, state), "states"))
        for f in filters:
            following = state | {f}
            if f in state or following in met or len(following) == len(filters):
                continue
            survivors = alive.filter(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                enter(following, survivors)
            finally:
                survivors.unpersist()

    root = rows.select(part, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *marks)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        enter(frozenset(), root)
    finally:
        root.unpersist()
    out = counted[0]
    for more in counted[1:]:
        out = out.union(more)
    return out


def orders(states: DataFrame, filters: Sequence[str], part: str, marks: Mapping[str, str]) -> DataFrame:
    """One row for each part, order and step; ``marks`` names the count of each mark.

    kept and removed (by this step's filter), redundant (fail it, but were removed earlier), unique_fails (fail it alone),
    and shapley: what the filter removes, summed over all orders.
    """
    k = len(filters)
    by_part = states.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("left", "removed", *marks)))).alias("_states"))
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "filter": f, "_n": filters.index(f), "_before": _name(filters, order[:i]), "_others": _name(filters, set(filters) - {f})}
        for order in permutations(filters)
        for i, f in enumerate(order)
    ]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,_n:int,_before:string,_others:string>>")
    zero = F.lit(0).cast("long")

    def figure(state: Column, which: str, n: Column) -> Column:
        return F.coalesce(F.get(F.try_element_at("_states", state)[which], n), zero)

    # A state stands before a filter in |state|! (k - 1 - |state|)! orders.
    shares = F.array(*[
        sum((figure(F.lit(_name(filters, before)), "removed", F.lit(n)) * (factorial(len(before)) * factorial(k - 1 - len(before))) for before in _subsets([x for x in filters if x != f])), zero)
        for n, f in enumerate(filters)
    ])
    rows = by_part.withColumn("_shapley", shares).select(part, "_states", "_shapley", F.inline(table))
    at, n = F.col("_before"), F.col("_n")
    left, removed = F.coalesce(F.try_element_at("_states", at)["left"], zero), figure(at, "removed", n)
    return rows.select(
        part, "filter_order", "step", "filter", (left - removed).alias("kept"), removed.alias("removed"), (figure(F.lit(""), "removed", n) - removed).alias("redundant"),
        figure(F.col("_others"), "removed", n).alias("unique_fails"), *[figure(at, m, n).alias(alias) for m, alias in marks.items()], F.get("_shapley", n).alias("shapley"),
    )


def _name(filters: Sequence[str], applied: Collection[str]) -> str:
    return "".join(f for f in filters if f in applied)


def _subsets(items: Sequence[str]) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for x in items:
        out += [(*s, x) for s in out]
    return out


def audit(rows: DataFrame, filters: Sequence[str], part: str = "part", marks: Mapping[str, str] | None = None) -> DataFrame:
    """The audit of boolean columns ``filters`` (true: fails) of ``rows``; ``marks`` maps further boolean columns to the names of their counts of rows lost."""
    filters, marks = list(filters), dict(marks or {})
    if not filters or len(set(filters)) < len(filters) or len(filters) > MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters of different names are needed")
    return orders(walk(rows, filters, part, list(marks)), filters, part, marks)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over ``docs``, for each source."""
    return audit(document_verdicts(docs, labels), "ABCDE", "part", {"good": "good_lost", "toxic": "toxic_lost"})
