"""Exact top-k by integer inner product with KD-trees per shard.

Rows are dealt to shards by hash. Each shard builds a KD-tree: the widest component of a node's rows is split at
its median until a node has at most LEAF rows; every node keeps the tight bounding box of its rows. A query
visits nodes best first by the largest inner product that any point of the box can have, and stops when that is
below its k-th score so far. The k-th scores of a first search, of one shard a query, are propagated as starting
bounds to the search of all other shards. A shard's vectors and its queries meet in one task, sorted so that the vectors come first:
each tree is built once a search and queries stream past it, a batch at a time: a stated query set against all rows.

Vectors that are null, or hold a null or a component that isn't finite, take no part; nor do rows whose vec_id is
null. Vectors of another length than the query have no product with it and are not its candidates. A query with
fewer candidates than k gets them all. Equal scores go to the smaller vec_id, so a box is skipped only if its bound is
below the k-th score, not if it equals it. Repeated vectors are candidates of their own, repeated vec_id too; a query's own
vec_id is never its candidate. Products too large for 64 bits are summed as whole numbers of any size; a score that is itself too large
is an error. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of a leaf, and of a shard on average: what one task holds besides a batch of queries.
LEAF, SHARD = 64, 8192
#: Below these, sums of products are exact as doubles, which multiply faster than integers, and as 64-bit integers.
EXACT, LONG = 1 << 52, 1 << 62


class Tree:
    """A KD-tree over integer rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.nodes = ids[order], rows[order], []
        self.most = max((abs(int(x)) for x in (rows.min(), rows.max())), default=0) if rows.size else 0
        at = np.arange(len(ids))
        self.nodes.append(None)
        stack = [(0, at)]
        self.low, self.high = [None], [None]
        while stack:
            node, at = stack.pop()
            part = self.rows[at]
            self.low[node], self.high[node] = low, high = part.min(0), part.max(0)
            spread = high - low
            if len(at) <= LEAF or not spread.any():
                self.nodes[node] = np.sort(at)
                continue
            axis, half = int(spread.argmax()), len(at) // 2
            cut = np.argpartition(part[:, axis], half)
            first = len(self.nodes)
            self.nodes[node] = first
            self.nodes += [None, None]
            self.low += [None, None]
            self.high += [None, None]
            stack += [(first, at[cut[:half]]), (first + 1, at[cut[half:]])]
        whole = (self.rows, np.array(self.low), np.array(self.high))
        #: Rows, low and high corners by the kind of number that holds a query's sums.
        self.kinds = {"O": None, "i8": whole, "f8": tuple(x.astype(np.float64) for x in whole) if self.most < EXACT else None}

    def numbers(self, widest: int) -> tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = self.most * widest * max(1, self.rows.shape[1])
        kind = "f8" if size < EXACT else "i8" if size < LONG else "O"
        if self.kinds[kind] is None:
            self.kinds[kind] = tuple(x.astype(kind) for x in self.kinds["i8"])
        return kind, self.kinds[kind]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) that are not below floor, best first."""
        kind, (rows, low, high) = self.numbers(max((abs(int(x)) for x in (query.min(), query.max())), default=0) if len(query) else 0)
        query = query.astype(kind)
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bounds = high @ up + low @ down
        best: list[tuple[int, int]] = []
        ahead = [(-int(bounds[0]), 0)]
        while ahead:
            bound, node = heapq.heappop(ahead)
            kth = best[0][0] if len(best) == k else None
            if floor is not None and (kth is None or floor > kth):
                kth = floor
            if kth is not None and -bound < kth:
                break
            inner = self.nodes[node]
            if not isinstance(inner, np.ndarray):
                for child in (inner, inner + 1):
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(ahead, (-int(bounds[child]), child))
                continue
            scores = rows[inner] @ query
            if kth is not None:
                keep = scores >= kth
                inner, scores = inner[keep], scores[keep]
            ids = self.ids[inner]
            mine = ids != own
            ids, scores = ids[mine], scores[mine]
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k] if kind != "O" else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                ids, scores = ids[top], scores[top]
            for s, i in zip(map(int, scores.tolist()), ids.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(best, reverse=True)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and q (array of long): floor(scale * x) of each component as a double; only whole, finite vectors."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; vectors and queries are (vec_id, q)."""
    rows = vectors.agg(F.count("*").alias("n")).first()["n"]
    shards = max(16, -(-rows // SHARD))
    none = F.lit(None).cast("long").alias("floor")
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.size("q").alias("dim"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "q", none, F.lit(None).cast("long").alias("asker"))
    home = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(shards))
    # A vec_id may be that of several queries: each is one of its own.
    ask = written(queries.select("vec_id", "q").withColumn("asker", F.monotonically_increasing_id()), "topk-queries").select("asker", F.col("vec_id").alias("id"), "q", F.size("q").alias("dim"), home.alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if len(b) else np.zeros(0, np.int64)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                part = b.slice(i, j - i)
                if tuple(keys[:2, i]) != shard:
                    shard, parts, tree = tuple(keys[:2, i]), [], None
                ids, rows = part.column(3).to_numpy(), _matrix(part.column(4))
                if not keys[2, i]:
                    parts.append((ids, rows))
                    continue
                if parts:
                    tree, parts = Tree(*(np.concatenate(x) for x in zip(*parts))), []
                if tree is not None:
                    asked = zip(part.column(6).to_pylist(), ids.tolist(), rows, part.column(5).to_pylist())
                    found = [(asker, own, -vec, score) for asker, own, q, floor in asked for score, vec in tree.search(q, own, k, floor)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), (), ()))], ["asker", "query_id", "vec_id", "score"])

    def searched(asks: DataFrame) -> DataFrame:
        both = dealt.unionByName(asks.withColumn("kind", F.lit(1)))
        return both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind").mapInArrow(run, "asker long, query_id long, vec_id long, score long")

    first = written(searched(ask.select(F.col("home").alias("shard"), "dim", "id", "q", none, "asker")), "topk-first")
    kth = first.groupBy("asker").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("asker", "floor")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    second = searched(ask.join(kth, "asker", "left").withColumn("shard", others).where("shard <> home").select("shard", "dim", "id", "q", "floor", "asker"))
    order = W.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embeddings_top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but the query's own."""
    rows = written(quantised(vectors), "topk-rows")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
