"""Approximate nearest neighbours by inner product with a permutation index.

Of a bounded sample of the vectors, those farthest from one another serve as pivots.  Every vector is represented by its POSTED nearest pivots in their order; the
index deals the vectors out in blocks, and in each block every pivot has a file of the vectors that name it, with the places at
which they do.  A query reads the files of its own pivots.  Footrule distance sums the differences of places, where a pivot that one
side lacks counts as the place behind the last; a pivot that both name brings them nearer by twice the smaller of the two counts of
places left.  The vectors of smallest footrule distance (ties included), and all whose permutation is nearly the query's own, as a
cluster of near copies of any size has it, are reranked by the exact inner product in double precision.

Equal vectors are one entry with its smallest ids, as many as a result can need, so copies of any number cost nothing.  Blocks of
vectors meet blocks of queries: no task holds more than one of either, and every query meets every vector's permutation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import counted_lookup, named, settled

#: Vectors that pivots are chosen from, pivots, and how many of them represent a vector.
SAMPLE, PIVOTS, POSTED = 2048, 128, 64
#: Candidates that a query of n vectors reranks: the nearest RERANKED * sqrt(n), and all of this share of the greatest nearness.
RERANKED, CLOSE = 20, 0.9
#: Vectors of a block, and queries of one: at least, at most, and parts that a small table is cut into.
LEAST, MOST, PARTS = 1 << 12, 1 << 15, 16
_HASH = "a", "b"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec, h) of the rows that take part: an id and a vector, neither zero nor with null or non-finite components.

    h: two 64-bit hashes of the vector.  Rows that repeat id and vector count once.
    """
    v = named(vec_col).cast("array<double>")
    rows = vectors.select(named(id_col).alias("id"), v.alias("vec")).filter("id is not null and size(vec) > 0")
    rows = rows.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    rows = rows.withColumn("vec", F.expr("transform(vec, x -> x + 0.0D)"))  # -0.0 becomes 0.0
    return rows.withColumn("h", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), F.col("vec")).alias("b"))).dropDuplicates(["id", "h"])


def dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one array; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


@dataclass
class Pivots:
    """Pivots in a space with one dimension more, in which every vector is as long as the longest: there, near is a large product."""

    rows: np.ndarray
    width: int
    longest: float

    @property
    def posted(self) -> int:
        return min(POSTED, len(self.rows))

    def permutations(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The nearest pivots of each row, nearest first; a query has nothing in the further dimension."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        near = x @ self.rows[:, :-1].T + rest[:, None] * self.rows[:, -1]
        return np.argsort(-near, axis=1, kind="stable")[:, : self.posted].astype(np.uint16)


def _chosen(classes: DataFrame, width: int, longest: float) -> Pivots:
    """Of the first SAMPLE vectors by a hash, the first and then again and again the one that is farthest from those chosen."""
    rows = classes.orderBy(F.xxhash64("h"), "h").select("vec").limit(SAMPLE).collect()  # SAMPLE vectors
    x = np.array([[*r["vec"], *[0.0] * (width - len(r["vec"]))] for r in rows]).reshape(-1, width)
    rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
    x = np.concatenate([x, rest[:, None]], axis=1)
    chosen, away = [], np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return Pivots(x[chosen], width, longest)


@dataclass
class Index:
    """entries: h, vec, ids (the smallest `most` of the vectors' ids), perm (pivots, 16 bits each), block; n of them in `blocks`."""

    entries: DataFrame
    pivots: Pivots
    n: int
    blocks: int
    most: int


def _parts(n: int) -> int:
    return max(1, math.ceil(n / min(MOST, max(LEAST, math.ceil(n / PARTS)))))


def build(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """The index of all vectors that are usable(), for searches of up to k neighbours; written to the shared folder."""
    smallest = Window.partitionBy("h").orderBy("id")
    few = usable(vectors, id_col, vec_col).withColumn("i", F.row_number().over(smallest)).filter(F.col("i") <= k + 1)
    classes = settled(few.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec")), "vectors")
    n, width, longest = classes.agg(F.count("*"), F.max(F.size("vec")), F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)"))).first()
    pivots = _chosen(classes, width or 1, longest or 0.0)
    blocks = _parts(n)

    def represented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            perm = pivots.permutations(dense(b.column("vec"), pivots.width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tobytes() for p in perm], pa.binary())], [*b.schema.names, "perm"])

    block = F.pmod(F.xxhash64(F.lit(2), F.col("h")), F.lit(blocks)).cast("int")
    table = classes.select(block.alias("block"), F.col("h.a").alias("a"), F.col("h.b").alias("b"), "ids", "vec")
    entries = settled(table.mapInArrow(represented, "block int, a long, b long, ids array<long>, vec array<double>, perm binary"), "permutations")
    return Index(entries, pivots, n, blocks, k + 1)


def files(perms: np.ndarray, pivots: int) -> np.ndarray:
    """A row for each pivot: how many places are left behind the one at which each vector names it; 0: it does not."""
    posted = perms.shape[1]
    out = np.zeros((pivots, len(perms)), np.uint8 if posted < 256 else np.uint16)
    out[perms.T, np.arange(len(perms))] = (posted - np.arange(posted))[:, None]
    return out


def nearness(lists: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """For every vector of a block, half of what the pivots that it shares with the query take off the largest footrule distance."""
    left = (len(perm) - np.arange(len(perm))).astype(lists.dtype)
    return np.minimum(lists[perm], left[:, None]).sum(axis=0, dtype=np.uint32)


def _searched(pivots: Pivots, rerank: int, most: int):
    """The best `most` of a block for each of a block's queries."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if block.num_rows and queries.num_rows:
            x, q = dense(block.column("vec"), pivots.width), dense(queries.column("vec"), pivots.width)
            ids = block.column("ids").to_pylist()
            lowest = np.array([i[0] for i in ids])
            lists = files(np.array([np.frombuffer(p, np.uint16) for p in block.column("perm").to_pylist()]), len(pivots.rows))
            for a, b, v, perm in zip(queries.column("a").to_pylist(), queries.column("b").to_pylist(), q, pivots.permutations(q, query=True), strict=True):
                near = nearness(lists, perm)
                least = np.partition(near, -rerank)[-rerank] if rerank < len(near) else 0
                best = np.flatnonzero(near >= min(least, CLOSE * len(perm) * (len(perm) + 1) / 2))
                exact = (x[best] * v).sum(axis=1)
                order = np.lexsort((lowest[best], -exact))[:most]
                pairs = sorted((-s, i) for s, at in zip(exact[order].tolist(), best[order].tolist(), strict=True) for i in ids[at])[:most]
                for column, value in zip(found, (a, b, [-s for s, _ in pairs], [i for _, i in pairs]), strict=True):
                    column.append(value)
        return pa.table(dict(zip((*_HASH, "scores", "ids"), found, strict=True)), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))]))

    return run


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query, nearest first, ties to the smaller id.

    A query's own id is no candidate of it.  Queries that are not usable() get no rows, nor do those that no other vector is left
    for; where there are fewer than k candidates, all are found.  An id that stands with several vectors is as many candidates,
    and as many queries under one query_id.  Ids must be integers.  Empty tables give empty results.
    """
    if k >= index.most:
        raise ValueError(f"the index was built for {index.most - 1} neighbours")
    asked = settled(usable(queries, id_col, vec_col), "queries")
    counts = asked.groupBy("h").agg(F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    total, distinct = asked.count(), counts.count()
    chunks = _parts(distinct)
    rerank = math.ceil(RERANKED * math.sqrt(index.n) / index.blocks) + index.most
    chunk = F.pmod(F.xxhash64(F.lit(3), F.col("h")), F.lit(chunks)).cast("int")
    left = index.entries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = counts.select(F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1))).alias("block"), chunk.alias("chunk"), F.col("h.a").alias("a"), F.col("h.b").alias("b"), "vec")
    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    parts = met.applyInArrow(_searched(index.pivots, rerank, index.most), "a long, b long, scores array<double>, ids array<long>")
    pairs = F.expr("transform(scores, (s, i) -> struct(-s as far, ids[i] as id))")
    top = parts.groupBy(F.struct(*_HASH).alias("h")).agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, index.most).alias("top"))
    answered = counted_lookup(asked.select("id", "h"), "h", settled(top.join(counts.select("h", "n"), "h"), "nearest"), "n", total)
    rest = F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k)
    out = answered.select(F.col("id").alias("query_id"), F.posexplode(rest).alias("i", "t"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.far")).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of exact (query_id, vec_id) that were found."""
    every = exact.select("query_id", "vec_id").distinct()
    n = every.count()
    return every.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
