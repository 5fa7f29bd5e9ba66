"""Vectors: normalising, semantic search, similar notes, reconciling. Scores are dot products of unit vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.patterns import in_folder
from .population import live


#: Query vectors that are sent to every task at most; 4,096 of 1,024 dimensions take 32 MB.
MOST_SENT = 4096
#: Vectors of a block that meets a block of queries.
BLOCK = 16384


class BadVector(ValueError):
    pass


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Unit length in double precision; zero stays zero."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def valid(v: Column, dimension: int) -> Column:
    return v.isNotNull() & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def normalise(vectors: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """Unit float32 vectors; a vector of another dimension or with non-finite values fails the job."""
    v = F.col(vector_col)
    checked = F.when(valid(v, dimension), unit(v)).otherwise(F.raise_error(F.lit("bad vector: wrong dimension or not finite")).cast("array<double>"))
    return vectors.withColumn(vector_col, checked.cast("array<float>"))


def unit_query(query: list[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in query))
    if not math.isfinite(size):
        raise BadVector("the query isn't finite")
    return [x / size for x in query] if size else list(query)


def semantic(vectors: DataFrame, query: list[float], k: int, folder: str | None = None, where: Column | None = None) -> DataFrame:
    """Top k rows (path, ordinal, score); folder and predicate hold before the limit."""
    own = vectors.filter(in_folder(F.col("folder"), folder))
    if where is not None:
        own = own.filter(where)
    q = F.lit(unit_query(query)).cast("array<double>")
    return own.withColumn("score", dot(F.col("embedding"), q)).orderBy(F.desc("score"), "path", "ordinal").limit(k)


def _best(own: pd.DataFrame, asked: pd.DataFrame, k: int, others: bool = False) -> pd.DataFrame:
    """The k best rows of ``own`` for each query (with ``others`` none of the note that the query is named after), rows without a score last; sums run in the order of ``dot``, so that ties stay ties."""
    own = own.sort_values(["path", "ordinal"], ignore_index=True)
    names = own["path"].to_numpy()
    sizes = np.array([-1 if v is None else len(v) for v in own["embedding"]], "i8")
    columns: dict[int, np.ndarray] = {}
    ids, at, scores = [], [], []
    for query_id, q in zip(asked["query_id"], asked["query"], strict=True):
        n = 0 if q is None else len(q)
        if n not in columns:
            columns[n] = np.full((n, len(own)), np.nan)
            if n and (sizes == n).any():
                columns[n][:, sizes == n] = np.stack(own["embedding"][sizes == n].to_numpy()).astype("f8").T
        score = np.where(sizes == n, 0.0, np.nan) if q is not None else np.full(len(own), np.nan)
        for column, x in zip(columns[n], q if n else (), strict=True):
            score += column * x
        order = np.where(np.isnan(score), np.inf, -score)
        if others:
            order[names == query_id] = np.nan  # sorts last, and is cut off
        last = np.partition(order, k - 1)[k - 1] if k < len(order) else np.nan
        near = np.arange(len(order)) if np.isnan(last) else np.nonzero(order <= last)[0]
        near = near[np.argsort(order[near], kind="stable")]
        near = near[~np.isnan(order[near])][:k]
        ids += [query_id] * len(near)
        at += near.tolist()
        scores += [None if x != x else x for x in score[near].tolist()]
    rows = own.iloc[at]
    found = {"query_id": ids, "path": rows["path"].tolist(), "ordinal": rows["ordinal"].tolist(), "score": scores}
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in found.items()})


def batch_semantic(vectors: DataFrame, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
    """Top k rows per row (query_id, query) of a stated query set: (query_id, rank, path, ordinal, score).

    With ``others`` a query id is a note's path, whose own rows are no candidates.

    Each task keeps the k best of each of its blocks for a query, so few rows are shuffled. Up to MOST_SENT
    queries are sent to every task; a larger set meets the vectors block by block.
    """
    own = vectors.select("path", "ordinal", "embedding")
    asked = queries.select("query_id", unit(F.col("query")).alias("query"))
    schema = StructType([asked.schema["query_id"], own.schema["path"], own.schema["ordinal"], StructField("score", DoubleType())])
    n = queries.count()
    if n <= MOST_SENT:
        sent = asked.toPandas()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _best(batch, sent, k, others)

        found = own.mapInPandas(run, schema)
    else:
        across, down = -(-n // MOST_SENT), max(1, -(-own.count() // BLOCK))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = own.withColumn("_v", F.pmod(F.xxhash64("path", "ordinal"), F.lit(down)).cast("int")).withColumn("_q", every(across))
        right = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("_v", every(down))
        found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(lambda v, q: _best(v, q, k, others), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "ordinal"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mean_vector(vectors: DataFrame) -> DataFrame:
    """Rows (path, mean): the mean of a note's unit vectors, at unit length; a zero mean stays zero."""
    each = vectors.select("path", F.posexplode("embedding").alias("at", "x"))
    means = each.groupBy("path", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    return listed.select("path", unit(F.col("mean")).alias("mean"))


def similar(vectors: DataFrame, path: str, k: int) -> DataFrame:
    """Rows nearest to a note's mean vector, its own left out before the limit."""
    mean = mean_vector(vectors.filter(F.col("path") == path)).select("mean")  # one row at most
    scored = vectors.filter(F.col("path") != path).crossJoin(F.broadcast(mean)).withColumn("score", dot(F.col("embedding"), F.col("mean"))).drop("mean")
    return scored.orderBy(F.desc("score"), "path", "ordinal").limit(k)


def near_notes(vectors: DataFrame, asked: DataFrame, limit: int = 5, pool: int = 1000) -> DataFrame:
    """Rows (path, other, rank): the ``limit`` notes nearest to each of the rows (path), by their best rows among the ``pool`` nearest."""
    means = mean_vector(vectors.join(asked.select("path").distinct(), "path", "left_semi"))
    rows = batch_semantic(vectors, means.select(F.col("path").alias("query_id"), F.col("mean").alias("query")), pool, others=True)
    best = rows.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= limit).select(F.col("query_id").alias("path"), F.col("path").alias("other"), "rank")


def attach_live(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows whose note is indexed, with its chunk_count."""
    return rows.join(live(documents).select("path", "chunk_count"), "path")


def embedding_text(sections: DataFrame, version: int = 2) -> Column:
    """The text that is embedded: the content alone (1), or title, heading, fields and a blank line before it (2)."""
    if version == 1:
        return F.col("content")
    head = F.concat_ws("\n", *(F.when(F.coalesce(F.length(F.col(c)), F.lit(0)) > 0, F.col(c)) for c in ("title", "heading", "summary") if c in sections.columns))
    return F.when(F.length(head) > 0, F.concat(head, F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))


def hash_embedding(text: str, dimension: int) -> list[float]:
    """Deterministic stand-in for a provider: signed token counts in hashed places, at unit length."""
    import hashlib

    out = [0.0] * dimension
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dimension] += 1.0 if h >> 63 else -1.0
    return unit_query(out)


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], text_col: str = "embedding_text", batch: int = 64) -> DataFrame:
    """Column embedding from a provider that takes a list of texts, ``batch`` texts a call; null where a call fails or falls short."""
    schema = rows.withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def call(texts: list[str]) -> list:
        try:
            made = list(provider(texts))
        except Exception:  # whatever a provider raises: its texts are asked for again by the next run
            made = []
        return made if len(made) == len(texts) else [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part[text_col].tolist()
            part["embedding"] = [v for at in range(0, len(texts), batch) for v in call(texts[at : at + batch])]
            yield part

    return rows.mapInPandas(run, schema)


def reconcile(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reused, missing, unbacked): chunks whose input is stored already, chunks to embed, stored paths without a note.

    ``current`` has (path, ordinal, folder, embedding_text), ``stored`` also embedding. Inputs are
    compared by hash, so an edited note embeds only the chunks whose text changed.
    """
    keyed = current.withColumn("input_hash", F.sha2("embedding_text", 256))
    known = stored.select(F.sha2("embedding_text", 256).alias("input_hash"), "embedding").dropDuplicates(["input_hash"])
    reused = keyed.join(known, "input_hash")
    missing = keyed.join(known.select("input_hash"), "input_hash", "left_anti")
    unbacked = stored.select("path").distinct().join(current.select("path"), "path", "left_anti")
    return reused, missing, unbacked


def import_matching(current: DataFrame, donor: DataFrame, same_identity: bool) -> DataFrame:
    """Rows of ``current`` whose embedding input a donor store has embedded, with its vectors; needs equal identities.

    Provider, model, variant, text format and dimension make up an identity; vectors compare only if all are equal.
    """
    if not same_identity:
        raise BadVector("the donor's vectors were made in another way")
    return reconcile(current, donor)[0].drop("input_hash")
