"""Importance resampling towards a target distribution, by hashed n-gram counts.

DuckDB runs within each task: SQL unnests the words of a bounded number of characters, a window
gives runs of words, a registered CRC deals them into buckets, and counts leave as one row a
document. Spark writes them as Parquet, merges them over all tasks, and scores each document from its
counts; a document's draw is its weight plus a Gumbel variate of its id, and the highest draws win.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .arrow_map import map_rows
from .store import constant, materialize

BUCKETS, LEAST_WORDS = 10_000, 20
#: Characters of text that DuckDB gets at a time.
CHARS = 250_000
#: A word: no control character, blank or other ASCII sign but letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD, _BREAK = re.compile(WORD), re.compile(WORD.replace("[^", "[").rstrip("+"))
_LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))

COUNTED = StructType([
    StructField("id", LongType()), StructField("total", BooleanType()), StructField("n_words", LongType()), StructField("n_features", LongType()),
    StructField("buckets", ArrayType(IntegerType())), StructField("counts", ArrayType(LongType())),
])

# A piece that goes on from another begins with the last words of that one, ``carried`` in number: a run counts where it ends beyond them.
# Every different word goes through the CRC once; a run's CRC follows from those of its words.
_SQL = """
WITH parts AS (SELECT row, place, carried, regexp_extract_all(text, '{word}') AS found FROM pieces),
words AS (SELECT row, place, carried, unnest(found) AS word, unnest(range(len(found))) AS k FROM parts),
different AS (SELECT word, crc(word) AS first, strlen(word) AS bytes FROM (SELECT DISTINCT word FROM words)),
known AS (SELECT word, first, joined({space}, first, bytes) AS next, bytes + 1 AS size FROM different),
runs AS (SELECT row, carried - k AS old, first{leads} FROM words JOIN known USING (word) WINDOW w AS (PARTITION BY place ORDER BY k)),
features AS ({features})
SELECT row, crc % {buckets} AS bucket, count(*) AS n FROM features GROUP BY ALL
UNION ALL SELECT row, -1, count(*) FROM runs WHERE old < 1 GROUP BY row
"""
_ONES, _NEAR = 0xFFFFFFFF, 64


def _moved(crc: int, size: int) -> int:
    """What a CRC turns into before ``size`` more bytes; that, XOR their own CRC, is the CRC of all."""
    return zlib.crc32(bytes(size), crc ^ _ONES) ^ _ONES


def _moves() -> np.ndarray:
    """``_moved`` by size up to ``_NEAR``, byte of the CRC and value of that byte; XOR over the bytes is that of the whole."""
    out = np.zeros((_NEAR + 1, 4, 256), dtype=np.int64)
    for size in range(_NEAR + 1):
        for byte in range(4):
            for bit in range(8):
                out[size, byte, 1 << bit : 2 << bit] = out[size, byte, : 1 << bit] ^ _moved(1 << 8 * byte + bit, size)
    return out


def _crc(texts: pa.Array) -> pa.Array:
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.string())
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data or b"")
    return pa.array([zlib.crc32(whole[a:b]) for a, b in zip(at, at[1:])], type=pa.int64())


def _joiner() -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    table = _moves()

    def joined(before: pa.Array, after: pa.Array, size: pa.Array) -> pa.Array:
        a, b, n = (np.asarray(c).astype(np.int64) for c in (before, after, size))
        near = np.minimum(n, _NEAR)
        out = b ^ table[near, 0, a & 255] ^ table[near, 1, a >> 8 & 255] ^ table[near, 2, a >> 16 & 255] ^ table[near, 3, a >> 24]
        for k in np.flatnonzero(n > _NEAR):
            out[k] = _moved(int(a[k]), int(n[k])) ^ int(b[k])
        return pa.array(out)

    return joined


def _statement(order: int, buckets: int) -> str:
    leads = "".join(f", lead(next, {k}) OVER w AS next{k}, lead(size, {k}) OVER w AS size{k}" for k in range(1, order))
    runs, crc = [], "first"
    for k in range(1, order + 1):
        runs.append(f"SELECT row, {crc} AS crc FROM runs WHERE old < {k}" + (f" AND next{k - 1} IS NOT NULL" if k > 1 else ""))
        crc = f"joined({crc}, next{k}, size{k})"
    return _SQL.format(word=WORD, leads=leads, features=" UNION ALL ".join(runs), buckets=buckets, space=zlib.crc32(b" "))


def pieces_of(text: str, carry: int, chars: int = CHARS) -> Iterator[tuple[int, str]]:
    """Pieces of at most ``chars`` characters, or more where a word is longer, and how many words each has of those before it."""
    begin, words = 0, []
    while begin < len(text):
        end = _BREAK.search(text, begin + chars)
        stop = end.start() if end else len(text)
        own = text[begin:stop]
        yield len(words), " ".join([*words, own])
        if stop < len(text):
            last = [m[0][::-1] for m in islice(_WORD.finditer(own[::-1]), carry)][::-1]
            words = [*words, *last][-carry:] if carry else []
        begin = stop


class Counter:
    """Takes texts and yields a row of bucket counts for each; a text may go through DuckDB in many pieces."""

    def __init__(self, order: int, buckets: int, chars: int = CHARS) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        self.db.create_function("joined", _joiner(), ["BIGINT"] * 3, "BIGINT", type="arrow")
        self.order, self.buckets, self.chars, self.sql = order, buckets, chars, _statement(order, buckets)
        self.keys: list[int | None] = []
        self.pieces: list[tuple[int, int, int, str]] = []
        self.size, self.open = 0, None  # open: counts and words of a row whose pieces went on beyond a call
        self.totals, self.words = np.zeros(buckets, dtype=np.int64), 0

    def add(self, key: int | None, text: str) -> Iterator[tuple]:
        self.keys.append(key)
        for carried, piece in pieces_of(text.encode().translate(_LOWER).decode(), self.order - 1, self.chars):
            if self.size >= self.chars:
                yield from self._count(True)
            self.pieces.append((len(self.keys) - 1, len(self.pieces), carried, piece))
            self.size += len(piece)
        if self.size >= self.chars:
            yield from self._count(False)

    def close(self) -> Iterator[tuple]:
        """What is left, then the task's totals."""
        yield from self._count(False)
        self.db.close()  # its memory goes back before the worker takes up another task
        yield None, True, self.words, int(self.totals.sum()), np.flatnonzero(self.totals), self.totals[self.totals > 0]

    def _count(self, goes_on: bool) -> Iterator[tuple]:
        """Count the pieces so far; with ``goes_on`` the last row has more."""
        names, kinds = ("row", "place", "carried", "text"), (pa.int32(), pa.int32(), pa.int64(), pa.string())
        columns = zip(*self.pieces, strict=True) if self.pieces else [()] * 4
        self.db.register("pieces", pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, columns, kinds, strict=True)}))
        found = self.db.execute(self.sql).fetchnumpy()
        self.db.unregister("pieces")
        row, bucket, n = (np.asarray(found[c]).astype(np.int64) for c in ("row", "bucket", "n"))
        words = np.zeros(len(self.keys), dtype=np.int64)
        words[row[bucket < 0]] = n[bucket < 0]
        line = np.lexsort((bucket, row))
        line = line[bucket[line] >= 0]
        row, bucket, n = row[line], bucket[line], n[line]
        self.words += int(words.sum())
        np.add.at(self.totals, bucket, n)
        bounds = np.searchsorted(row, np.arange(len(self.keys) + 1))
        keys, self.keys, self.pieces, self.size, before, self.open = self.keys, [], [], 0, self.open, None
        for k, key in enumerate(keys):
            own, times, many = bucket[bounds[k] : bounds[k + 1]], n[bounds[k] : bounds[k + 1]], int(words[k])
            unfinished = goes_on and k == len(keys) - 1
            if unfinished or before is not None and not k:
                all_of_it = np.zeros(self.buckets, dtype=np.int64) if before is None or k else before[0]
                all_of_it[own] += times
                many += before[1] if before is not None and not k else 0
                if unfinished:
                    self.keys, self.open = [key], (all_of_it, many)
                    continue
                own = np.flatnonzero(all_of_it)
                times = all_of_it[own]
            yield key, False, many, int(times.sum()), own, times


def count_features(df: DataFrame, order: int = 2, buckets: int = BUCKETS, chars: int = CHARS, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (id, total, n_words, n_features, buckets, counts): one a row of ``df``, and one a task with its totals.

    Words are lower-cased in A-Z only; features are all runs of 1 to ``order`` words, joined by a
    space, repeats counted; a feature's bucket is its CRC modulo ``buckets``. Null texts have none.
    """

    def start() -> Callable:
        counter = Counter(order, buckets, chars)

        def rows_of(found: Iterator[tuple]) -> Iterator[dict[str, list]]:
            rows = list(found)
            if rows:
                yield dict(zip(COUNTED.fieldNames(), map(list, zip(*rows, strict=True)), strict=True))

        def step(rows: dict[str, list] | None):
            if rows is None:
                yield from rows_of(counter.close())
                return
            for key, text in zip(rows["id"], rows["text"], strict=True):
                yield from rows_of(counter.add(key, text or ""))

        return step

    key = F.col(id_col) if id_col else F.lit(None)
    return materialize(map_rows(df.select(key.cast("long").alias("id"), F.col(text_col).alias("text")), start, COUNTED, closing=True), "counts")


def totals(counted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket over all rows: ``buckets`` numbers, whatever the input."""
    own = counted.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    found = {r[0]: r[1] for r in own.collect()}
    return [found.get(k, 0) for k in range(buckets)]


def gains(raw: list[int], target: list[int]) -> list[int]:
    """A thousand times the log ratio of a bucket's share in the target and in the raw texts, one added to each count."""
    s, t, n = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw, target, strict=True)]


def gumbel(key: int | None, seed: int) -> int:
    """A thousand times the Gumbel variate that a document's id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = StructType([StructField(n, LongType()) for n in ("id", "n_words", "n_features", "weight", "score")])


def score(counted: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score): the floored mean gain over a document's features, and that plus its draw."""
    table, arrow = np.array(gain, dtype=np.int64), to_arrow_schema(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, n = batch.column("id").to_pylist(), batch.column("n_words"), batch.column("n_features").to_numpy()
            own = np.append(0, np.cumsum(table[batch.column("buckets").flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()))
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False)))
            weight = np.where(n > 0, (own[ends[1:]] - own[ends[:-1]]) // np.maximum(n, 1), 0)
            drawn = weight + np.array([gumbel(k, seed) for k in keys], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), words, batch.column("n_features"), pa.array(weight), pa.array(drawn)], schema=arrow)

    return counted.filter("not total").select("id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, SCORED)


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank``: 1, 2, ... by falling score and rising id for that share of the rows with enough words, null for all others.

    Rows are sorted by range, over all tasks; a row's rank is its place in its range plus the rows
    of the ranges before it, whose numbers alone the driver sees.
    """
    able = scored.filter(F.col("n_words") >= least_words)
    ordered = able.withColumn("__nl_tie", F.xxhash64("n_features", F.monotonically_increasing_id()))
    ordered = ordered.repartitionByRange(F.desc("score"), F.asc_nulls_last("id"), F.asc("__nl_tie")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"), F.asc("__nl_tie"))
    placed = materialize(ordered.drop("__nl_tie").withColumn("__nl_at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("__nl_at", 33).cast("int"), F.col("__nl_at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, all_rows = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(all_rows)
        all_rows += sizes.get(k, 0)
    rank = inside + F.element_at(constant(before, "long"), part + 1) + 1 if before else F.lit(None).cast("long")
    won = placed.withColumn("rank", rank).drop("__nl_at")
    won = won.withColumn("rank", F.when(F.col("rank") <= percent * all_rows // 100, F.col("rank")))
    others = scored.filter((F.col("n_words") < least_words) | F.col("n_words").isNull())
    return won.unionByName(others.withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 25, order: int = 2, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, rank), one a row of ``df``; drawn rows have a rank.

    Null and empty texts have no words, weight 0 and no rank. A null id draws like an id without
    digits and comes last among equal scores. Repeated rows are scored and drawn each on its own;
    rows that tie in score and id are interchangeable. Texts of any length are counted in pieces of
    bounded size. An empty target or an empty table gives counts of zero, an empty table no rows.
    Other columns are never read, so their names can't clash.

    A task's state is its totals; ``buckets`` sums go to the driver and as many gains to all tasks.
    """
    counted = count_features(df, order, buckets, id_col=id_col, text_col=text_col)
    wanted = count_features(target, order, buckets, id_col=None, text_col=target_text)
    gain = gains(totals(counted, buckets), totals(wanted, buckets))
    scored = materialize(score(counted, gain, seed), "scored")
    return draw(scored, percent, least_words).withColumnRenamed("id", id_col)


def drawn_documents(df: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id was drawn; merged at every size, as the draw grows with the table."""
    won = ranked.filter("rank is not null").select(id_col).distinct()
    return df.join(won.hint("merge"), id_col, "left_semi").select(*df.columns)
