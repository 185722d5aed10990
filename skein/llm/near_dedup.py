"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates, exact links.

``near_duplicates(docs)`` returns one row per input row: doc_id, n_shingles, component_id, kept.  Two documents are
linked when 100 * |A & B| >= 75 * |A | B| over their full sets of five-word shingles.

How no link between different sets is lost without emitting the pairs of a group: documents with equal sets become one
node first.  Every bucket then tests its members against its centre only (a star).  A bucket whose members all fell
into one component is finished.  The nodes of the others are joined on the rarest shingles of their sets, of which linked
nodes must share one, and only nodes of different components whose counts leave room for a link are tested.  With 24
bands of 3 bins a pair at the threshold misses every bucket with probability (1 - 0.75**3)**24, about 2e-6.

Defined results: null, empty or blank text has n_shingles 0, is linked with nothing and is its own component; fewer
words than five form one shingle; rows that share a doc_id count as one document and each gets a row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import mix, shingles, text_slices, words
from .components import connected_components
from .staging import stage

SHINGLE_WORDS, BANDS, ROWS, PERCENT = 5, 24, 3, 75
#: Words of 64 bits in the parity map of a set; the maps of two sets differ in no more bits than the sets in shingles.
PARITY_WORDS = 16
#: Ids of so many candidate documents (8 bytes each) are broadcast at most; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_FEATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def _signature(unique: np.ndarray, bins: int, probe: np.ndarray) -> np.ndarray:
    """One-permutation minima of sorted unique hashes; an empty bin borrows from the bins of its own probe sequence."""
    at = ((unique >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sig = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    filled[at[first]] = True
    sig[at[first]] = unique[first]
    if len(first) < bins:
        ok = filled[probe]
        step = ok.argmax(axis=1)
        src = probe[np.arange(bins), step]
        src = np.where(ok[np.arange(bins), step], src, at[first[0]].astype(np.int64))
        sig = np.where(filled, sig, sig[src])
    return sig


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins = BANDS * ROWS
    # The probe sequence of a bin is the same for all documents: that is what makes borrowed bins comparable.
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(16 * bins, dtype=np.uint64)[None, :]
    probe = (mix(grid + np.uint64(77)) % np.uint64(bins)).astype(np.int64)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch, lo, hi, data, off in text_slices(batches):
        _, _, h, woff = words(data, off)
        sh, soff = shingles(h, woff, SHINGLE_WORDS)
        n = hi - lo
        size, digest, sigs = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, bins), np.uint64)
        for r in np.flatnonzero(np.diff(soff)):
            u = np.unique(sh[soff[r] : soff[r + 1]])
            size[r] = len(u)
            digest[r, 0] = np.bitwise_xor.reduce(mix(u + np.uint64(1)))
            digest[r, 1] = np.add.reduce(mix(u ^ np.uint64(0x5851F42D4C957F2D)))
            sigs[r] = _signature(u, bins, probe)
        b = sigs.reshape(n, BANDS, ROWS)
        key = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            key = mix(key + b[:, :, j])
        key = mix(key + salt[None, :])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(key.ravel().view(np.int64)))
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, n)
        yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(digest[:, 0].copy().view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), lists], ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"])


def _parity(unique: np.ndarray) -> np.ndarray:
    """For each bit of the map, whether an odd number of shingles falls on it."""
    odd = np.bincount((unique >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, off in text_slices(batches):
        _, _, h, woff = words(data, off)
        sh, soff = shingles(h, woff, SHINGLE_WORDS)
        sets = [np.unique(sh[soff[r] : soff[r + 1]]) for r in range(hi - lo)]
        flat = np.concatenate(sets).view(np.int64)
        maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.concatenate([_parity(s) for s in sets])))
        cut = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), maps], ["doc_id", "set", "parity"])


def _sets_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The full shingle sets of all documents in ``pairs`` (a, b)."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stage(texts.join(side, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set array<long>, parity array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(common * 100 >= union * PERCENT).select("a", "b").distinct()


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefixes(alive: DataFrame, sets: DataFrame) -> DataFrame:
    """(item, node, component, shared, own): the shingles of a node of which a linked node must have one.

    ``own`` counts the shingles that no other node of ``alive`` has, ``shared`` the others.  A link needs three quarters
    of the larger set in common, so of the rarest ``size - ceil(0.75 size) + 1`` shingles (the own ones first) one is
    common to both nodes; nodes whose own shingles fill that prefix have no link left.
    """
    side = F.broadcast(alive) if alive.count() <= BROADCAST_IDS else alive
    own_sets = sets.join(side, sets.doc_id == side.node).select("node", "component", F.size("set").cast("long").alias("size"), "set")
    items = own_sets.select("node", "component", "size", F.explode("set").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = items.join(often, "item")
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("shared", F.count(F.lit(1)).over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("n", "item")))
    prefix = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1
    ranked = ranked.withColumn("own", F.col("size") - F.col("shared"))
    return ranked.filter(F.col("rank") + F.col("own") <= prefix).select("item", "node", "component", "shared", "own")


def _possible(x: str, y: str) -> Column:
    """Whether two nodes of different components leave room for a link: their own shingles are in no intersection."""
    least, most = F.least(f"{x}.shared", f"{y}.shared"), F.greatest(f"{x}.shared", f"{y}.shared")
    room = least * 100 >= (most + F.col(f"{x}.own") + F.col(f"{y}.own")) * PERCENT
    return (F.col(f"{x}.item") == F.col(f"{y}.item")) & (F.col(f"{x}.component") != F.col(f"{y}.component")) & room


def _alike(x: str, y: str) -> Column:
    """Whether the parity maps leave room for a link: it allows one difference for seven shingles of the two sets.

    |A ^ B| <= 25 % of |A | B|, and |A | B| = (|A| + |B| + |A ^ B|) / 2; the maps show no more differences than there are.
    """
    differ = sum((F.bit_count(F.col(f"{x}.parity")[k].bitwiseXOR(F.col(f"{y}.parity")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    both = F.col(f"{x}.shared") + F.col(f"{x}.own") + F.col(f"{y}.shared") + F.col(f"{y}.own")
    return differ * (100 + PERCENT) <= both * (100 - PERCENT)


def _links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) that give the same components as all links of ``nodes`` (doc_id, bands)."""
    rows = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    centres = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre <> last").select("bucket", "centre")
    members = stage(rows.join(centres, "bucket"), "members")
    pairs = stage(members.filter("node <> centre").select(*_ordered(F.col("centre"), F.col("node"))).distinct(), "pairs")
    sets = _sets_of(pairs, texts)
    edges = stage(_verified(pairs, sets), "edges")
    # Buckets whose members are in one component need no more tests.
    tagged = members.join(connected_components(edges), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_ = tagged.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    alive = stage(tagged.join(open_, "bucket", "left_semi").select("node", "component").distinct(), "alive")
    if alive.isEmpty():
        return edges
    prefixes = stage(_prefixes(alive, sets), "prefixes")
    # Of a large group of alike nodes one profile is compared first; what no profile leaves room for is done.
    profiles = prefixes.select("item", "component", "shared", "own").distinct()
    left = stage(prefixes.alias("x").join(profiles.alias("y"), _possible("x", "y"), "left_semi"), "left")
    maps = sets.select(F.col("doc_id").alias("node"), "parity")
    left = stage(left.join(maps, "node"), "left")
    tried = left.alias("x").join(left.alias("y"), _possible("x", "y") & (F.col("x.node") < F.col("y.node")) & _alike("x", "y"))
    pairs = stage(tried.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    return stage(edges.union(_verified(pairs, sets)), "edges")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = stage(texts.mapInArrow(_features, _FEATURES), "features")
    some = features.filter("n_shingles > 0")
    classes = stage(some.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = some.join(classes.select(F.col("node").alias("doc_id"), "set_hi", "set_lo", "n_shingles"), ["doc_id", "set_hi", "set_lo", "n_shingles"], "left_semi").select("doc_id", "bands")
    comp = connected_components(_links(nodes, texts))
    classes = classes.join(comp, "node", "left").select("set_hi", "set_lo", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = features.drop("bands").join(classes, ["set_hi", "set_lo", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; all columns stay."""
    lost = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    lost = stage(lost, "lost")
    side = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    return docs.join(side, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
