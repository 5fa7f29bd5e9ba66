"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Vectors are dealt into blocks, and each
block stores an inverted file for every pivot: the vectors that list it and the place where they do.
A query walks the files of its own pivots, which gives the footrule distance of all the block's
vectors up to a constant; the best share of them is ranked again by the true distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .arrow_map import map_rows
from .store import hash_sample, materialize

PIVOTS, PREFIX, RERANK = 1024, 128, 0.045
BLOCK, CHUNK = 8192, 8192

INDEX = StructType([StructField("vec_id", LongType()), StructField("dim", IntegerType()), StructField("block", IntegerType()), StructField("vector", BinaryType()), StructField("prefix", BinaryType())])
#: A row per block and pivot, and one (pivot -1) with the ids and vectors of the block, to whose places the others refer.
FILES = StructType([*(StructField(n, IntegerType()) for n in ("dim", "block", "pivot")), *(StructField(n, BinaryType()) for n in ("members", "places", "ids", "vectors"))])
FOUND = StructType([StructField("ask", LongType()), StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


@dataclass(frozen=True)
class PermutationIndex:
    """``rows``: vec_id, dim, block, vector (doubles), prefix (numbers of its nearest pivots, in order), for every usable
    vector; ``files``: the stored inverted files, by block. Vectors of one dimension are an index of their own."""

    pivots: dict[int, np.ndarray]
    rows: DataFrame
    files: DataFrame
    count: int


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector that isn't null, zero, or holding null or non-finite components."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK) -> PermutationIndex:
    """Index every usable vector and post it. The fit is a sample of at most ``pivots`` vectors of each dimension, by a hash of the id.

    Vectors that are null, zero, or hold null or non-finite components are left out, as are rows with a
    null id, which no result could name. A distance needs equal dimensions, so each dimension has pivots
    and blocks of its own (the driver holds those of all). Rows that repeat are indexed each. Other
    columns are never read. An empty table gives an empty index.
    """
    rows = _usable(df, id_col, vector_col)
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = {d: np.array(sorted(r.v for r in hash_sample(rows.filter(F.col("dim") == d), pivots, "vec_id").select("v").collect()), dtype=np.float64) for d in counts}
    blocks = F.lit(1)
    for d, n in counts.items():
        blocks = F.when(F.col("dim") == d, F.lit(max(1, math.ceil(n / block)))).otherwise(blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))  # of the whole row, as ids may repeat

    def start() -> Callable:
        def step(batch: dict[str, list]):
            out: dict[str, list] = {n: list(batch.get(n, [])) for n in ("vec_id", "dim", "block")} | {"vector": [b""] * len(batch["dim"]), "prefix": [b""] * len(batch["dim"])}
            dims = np.array(batch["dim"])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([batch["v"][k] for k in at], dtype=np.float64)
                order = np.argsort(_distances(x, chosen[int(d)]), axis=1, kind="stable")[:, :prefix].astype("<u2")
                for k, v, p in zip(at, x, order, strict=True):
                    out["vector"][k], out["prefix"][k] = v.tobytes(), p.tobytes()
            yield out

        return step

    index = materialize(map_rows(dealt, start, INDEX), "index")
    files = materialize(index.groupBy("dim", "block").applyInArrow(_post, FILES), "files")
    return PermutationIndex(chosen, index, files, sum(counts.values()))


def _post(block: pa.Table) -> pa.Table:
    """The inverted files of one block."""
    ids = np.array(block.column("vec_id"), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    keys = {n: block.column(n)[0].as_py() for n in ("dim", "block")}
    vectors, prefix = (block.column(n).to_pylist() for n in ("vector", "prefix"))
    lists = np.frombuffer(b"".join(prefix[k] for k in order), dtype="<u2").reshape(len(order), -1)
    flat = lists.ravel()
    line = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[line], return_index=True)
    out = [keys | {"pivot": -1, "ids": ids[order].tobytes(), "vectors": b"".join(vectors[k] for k in order)}]
    for pivot, own in zip(used.tolist(), np.split(line, first[1:]), strict=True):
        members, places = np.divmod(own, lists.shape[1])
        out.append(keys | {"pivot": pivot, "members": members.astype("<u4").tobytes(), "places": places.astype("<u2").tobytes()})
    return pa.Table.from_pylist(out, schema=to_arrow_schema(FILES))


def search_block(ids: np.ndarray, vectors: np.ndarray, files: dict[int, tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, query_prefix: np.ndarray, k: int, rerank: float) -> list[tuple[int, int, float]]:
    """The k nearest found in one block for each query: (place of the query, vector id, distance); a vector of the query's own id is no candidate."""
    n, keep = len(ids), query_prefix.shape[1]
    depth = min(n, max(8 * k, math.ceil(rerank * n)) + 1)
    none = (np.empty(0, dtype=np.int64),) * 2
    out = []
    for place, (own, q, pivots) in enumerate(zip(query_ids, queries, query_prefix, strict=True)):
        spans = [files.get(int(p), none) for p in pivots]
        who = np.concatenate([members for members, _ in spans])
        # footrule = constant - 2 * sum over shared pivots of (prefix length - larger place)
        gain = np.concatenate([keep - np.maximum(places, at) for at, (_, places) in enumerate(spans)])
        total = np.bincount(who, weights=gain, minlength=n).astype(np.int64) * n + np.arange(n - 1, -1, -1)  # ties to smaller ids
        near = np.argpartition(-total, depth - 1)[:depth] if depth < n else np.arange(n)
        near = near[ids[near] != own]
        d = vectors[near] - q
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        out += [(place, int(ids[near[i]]), float(d[i])) for i in np.lexsort((ids[near], d))[:k]]
    return out


def search(index: PermutationIndex, queries: DataFrame, k: int = 10, rerank: float = RERANK, chunk: int = CHUNK) -> DataFrame:
    """The k nearest vectors found for every row of ``queries``, which has the index's own columns.

    The stored files of each block meet chunks of about ``chunk`` queries of its dimension, so memory
    doesn't grow with either side: a query has candidates in every block. In each block the best
    ``rerank`` share by footrule distance, at least 8 k, is ranked by the true distance; recall is
    measured against brute force in the tests. Columns: query_id, rank (from 1), vec_id, score. Ties go
    to the smaller vec_id; fewer than k candidates are all returned. Rows that repeat an id are
    candidates each, but never for that id; as queries, each has its own k rows, ranked from 1.
    """
    chunks = max(1, math.ceil(queries.count() / chunk))
    left = index.files.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # every query row has a number of its own, written once, by which its neighbours are ranked
    numbered = materialize(queries.select("vec_id", "dim", "vector", "prefix").withColumn("ask", F.monotonically_increasing_id()), "asked")
    asked = numbered.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.lit(chunks)).cast("int"))
    blocks = index.files.filter("pivot = -1").select(F.col("dim").alias("of"), F.col("block").alias("own"))  # other names, as both sides come from one table
    right = asked.join(blocks, F.col("dim") == F.col("of")).withColumnRenamed("own", "block").drop("of")

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        found = _meet(stored, asked, k, rerank) if stored.num_rows and asked.num_rows else []
        ids, asks = (np.array(asked.column(c), dtype=np.int64) for c in ("vec_id", "ask"))
        at = np.array([f[0] for f in found], dtype=np.int64)
        return pa.table({"ask": pa.array(asks[at]), "query_id": pa.array(ids[at]), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    keys = ("dim", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast(IntegerType()).alias("rank"), "vec_id", "score")


def _meet(stored: pa.Table, asked: pa.Table, k: int, rerank: float) -> list[tuple[int, int, float]]:
    dim = asked.column("dim")[0].as_py()
    files, ids, vectors = {}, np.empty(0, dtype=np.int64), np.empty((0, dim))
    for row in stored.select(["pivot", "members", "places", "ids", "vectors"]).to_pylist():
        if row["pivot"] < 0:
            ids, vectors = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["vectors"]).reshape(-1, dim)
        else:
            files[row["pivot"]] = np.frombuffer(row["members"], dtype="<u4").astype(np.int64), np.frombuffer(row["places"], dtype="<u2").astype(np.int64)
    n = asked.num_rows
    q, prefix = (b"".join(asked.column(c).to_pylist()) for c in ("vector", "prefix"))
    return search_block(ids, vectors, files, np.array(asked.column("vec_id"), dtype=np.int64), np.frombuffer(q).reshape(n, dim), np.frombuffer(prefix, dtype="<u2").astype(np.int64).reshape(n, -1), k, rerank)
