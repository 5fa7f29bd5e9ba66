"""Ranked keyword search: postings, boolean evaluation and BM25, as joins and aggregates."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..functions.fts_query import Combine, Near, Node, Phrase, parse_lenient, phrases
from ..model import LENGTHS, POSTINGS, SCOPES
from ..shared import give_back

COLUMNS = SCOPES["all"]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def simple_terms(text: Column) -> Column:
    """Array of unstemmed ASCII tokens, without Python."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _plain_tokens(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^a-z0-9]+")


def _stemmed_tokens() -> Callable[[pa.Array], pa.ListArray]:
    known = T.Stems()
    return lambda texts: pa.array([T.terms(t or "", known) for t in texts.to_pylist()], pa.list_(pa.string()))


def _flat(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and place in its row of every token that isn't empty."""
    rows, terms = pc.list_parent_indices(tokens), pc.list_flatten(tokens)
    full = pc.not_equal(terms, "")
    rows, terms = rows.filter(full).to_numpy(zero_copy_only=False), terms.filter(full)
    first = np.searchsorted(rows, np.arange(len(tokens)))
    return rows, terms, np.arange(len(rows)) - first[rows]


#: Bytes of text that are cut into tokens at a time.
SLICE_BYTES = 1_000_000


@dataclass(frozen=True)
class Asked:
    """The terms, and beginnings of terms, that a query looks for."""

    terms: frozenset[str]
    prefixes: frozenset[str] = frozenset()

    @classmethod
    def by(cls, node: Node, tokenize: Callable[[str], list[str]] = T.terms) -> Asked:
        if isinstance(node, Combine):  # what comes after NOT is looked for too
            left, right = cls.by(node.left, tokenize), cls.by(node.right, tokenize)
            return cls(left.terms | right.terms, left.prefixes | right.prefixes)
        terms, prefixes = set(), set()
        for phrase in phrases(node):
            tokens = tokenize(phrase.text)
            if phrase.prefix and tokens:
                prefixes.add(tokens.pop())
            terms.update(tokens)
        return cls(frozenset(terms), frozenset(prefixes))

    def within(self, texts: pa.Array) -> np.ndarray:
        """Which lower-case texts may hold one of them."""
        return reduce(np.logical_or, (pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in sorted(self.terms | self.prefixes)), np.zeros(len(texts), dtype=bool))

    def among(self, terms: pa.Array) -> np.ndarray:
        found = pc.is_in(terms, value_set=pa.array(sorted(self.terms), terms.type)).to_numpy(zero_copy_only=False)
        return reduce(np.logical_or, (pc.starts_with(terms, x).to_numpy(zero_copy_only=False) for x in sorted(self.prefixes)), found)


def _slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of their texts; only a single longer row exceeds ``SLICE_BYTES``."""
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def build_postings(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, stemmed: bool = True, asked: Asked | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of rows (path, ordinal, <columns>); with ``asked`` the postings of those terms alone.

    A chunk's postings lie in its own row, so nothing is shuffled: each slice of a batch is cut into tokens
    and grouped by row and term at once. Lengths of unstemmed chunks need no Python.
    """
    own = rows.select(*dict.fromkeys(["path", "ordinal", *columns]))  # the path may be searched too
    schema = to_arrow_schema(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _stemmed_tokens() if stemmed else _plain_tokens
        for batch in _slices(batches, columns):
            if asked is not None and not stemmed:  # a text without their letters has no such token
                batch = batch.filter(pa.array(reduce(np.logical_or, (asked.within(pc.utf8_lower(pc.fill_null(batch.column(c), ""))) for c in columns))))
            if not batch.num_rows:
                continue
            found = {c: _flat(tokens_of(batch.column(c))) for c in columns}
            size = pa.array(sum(np.bincount(at, minlength=batch.num_rows) for at, _, _ in found.values()), pa.int64())
            made = []
            for c, (at, terms, places) in found.items():
                if asked is not None:
                    keep = asked.among(terms)
                    at, terms, places = at[keep], terms.filter(pa.array(keep)), places[keep]
                if not len(at):
                    continue
                grouped = pa.table({"row": at, "term": terms, "p": pa.array(places, pa.int32())}).group_by(["row", "term"], use_threads=False).aggregate([("p", "list")]).combine_chunks()
                row, positions = grouped["row"].combine_chunks(), grouped["p_list"].combine_chunks()
                values = [grouped["term"].combine_chunks(), batch.column("path").take(row), batch.column("ordinal").take(row), pa.repeat(pa.scalar(c), len(row)), pc.list_value_length(positions), positions, size.take(row)]
                made.append(pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema))
            if made:  # a slice's rows go on by term, as a store sorts them: runs in order are only merged
                own_rows = pa.Table.from_batches(made).combine_chunks()
                yield from own_rows.take(pc.sort_indices(own_rows["term"])).to_batches()
        give_back()

    if not stemmed:
        tokens = (F.size(simple_terms(F.coalesce(F.col(c), F.lit("")))) for c in columns)
        return own.mapInArrow(run, POSTINGS), rows.select("path", "ordinal", reduce(lambda a, b: a + b, tokens).cast("long").alias("dl"))
    lengths = to_arrow_schema(LENGTHS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, columns):
            size = [sum(T.count_words(t or "") for t in texts) for texts in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("ordinal").cast(lengths.field("ordinal").type), pa.array(size, pa.int64())], schema=lengths)
        give_back()

    return own.mapInArrow(run, POSTINGS), own.mapInArrow(measure, LENGTHS)


KEY = ("path", "ordinal", "col")


def _phrase_hits(postings: DataFrame, phrase: Phrase, tokenize: Callable[[str], list[str]]) -> DataFrame:
    """Rows (path, ordinal, col, dl, positions) where a phrase starts."""
    own = postings if phrase.columns is None else postings.filter(F.col("col").isin(*phrase.columns) if phrase.columns else F.lit(False))
    tokens = tokenize(phrase.text)
    if not tokens:
        return own.filter(F.lit(False)).select(*KEY, "dl", "positions")
    hits = None
    for at, token in enumerate(tokens):
        if phrase.prefix and at == len(tokens) - 1:
            some = own.filter(F.col("term").startswith(token)).groupBy(*KEY, "dl").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
        else:
            some = own.filter(F.col("term") == token)
        some = some.select(*KEY, "dl", _shifted("positions", at).alias("_p"))
        hits = some if hits is None else hits.join(some.select(*KEY, F.col("_p").alias("_q")), [*KEY]).select(*KEY, "dl", F.array_intersect("_p", "_q").alias("_p")).filter(F.size("_p") > 0)
    hits = hits.select(*KEY, "dl", F.col("_p").alias("positions"))
    return hits.withColumn("positions", F.filter("positions", lambda p: p == 0)).filter(F.size("positions") > 0) if phrase.first else hits


def _near_hits(postings: DataFrame, near: Near, tokenize: Callable[[str], list[str]]) -> list[DataFrame]:
    """Each phrase's hits that have all the others within the distance, in the same column."""
    sizes = [len(tokenize(p.text)) for p in near.phrases]
    each = [_phrase_hits(postings, p, tokenize).withColumnRenamed("positions", f"_p{k}") for k, p in enumerate(near.phrases)]
    joined = reduce(lambda a, b: a.join(b.drop("dl"), [*KEY]), each)
    return [joined.select(*KEY, "dl", _close(k, sizes, near.distance).alias("positions")).filter(F.size("positions") > 0) for k in range(len(sizes))]


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by) if by else F.col(positions)


def _close(k: int, sizes: list[int], distance: int) -> Column:
    """Starts of phrase ``k`` that have a start of every other phrase with at most ``distance`` tokens between."""

    def beside(p: Column, j: int) -> Column:
        return F.exists(f"_p{j}", lambda q: F.greatest(q - (p + sizes[k]), p - (q + sizes[j])) <= distance)

    def all_beside(p: Column) -> Column:
        return reduce(lambda a, b: a & b, [beside(p, j) for j in range(len(sizes)) if j != k])

    return F.filter(f"_p{k}", all_beside)


@dataclass(frozen=True)
class _Leaf:
    """What one condition of a query counts: a single word, found by a filter of postings, or hits that joins have found."""

    word: str | None = None
    columns: tuple[str, ...] | None = None
    hits: DataFrame | None = None


def _leaves(postings: DataFrame, node: Phrase | Near, tokenize: Callable[[str], list[str]]) -> list[_Leaf]:
    if isinstance(node, Near):
        return [_Leaf(hits=hits) for hits in _near_hits(postings, node, tokenize)]
    tokens = tokenize(node.text)
    if len(tokens) == 1 and not node.prefix and not node.first:
        return [_Leaf(tokens[0], node.columns)]
    return [_Leaf(hits=_phrase_hits(postings, node, tokenize))]


def _evaluate(postings: DataFrame, node: Node, tokenize, leaves: list[_Leaf], scoring: list[int], counts: bool = True) -> Column:
    """Condition over columns f0, f1, ... of the leaves, which are appended; ``scoring`` gets those that score."""
    if isinstance(node, Combine):
        left = _evaluate(postings, node.left, tokenize, leaves, scoring, counts)
        right = _evaluate(postings, node.right, tokenize, leaves, scoring, counts and node.op != "NOT")
        return left | right if node.op == "OR" else left & (right if node.op == "AND" else ~right)
    first = len(leaves)
    leaves += _leaves(postings, node, tokenize)
    if counts:
        scoring += range(first, len(leaves))
    return F.col(f"f{first}") > 0


def _counted(postings: DataFrame, leaves: list[_Leaf], weight: Column) -> DataFrame:
    """Rows (path, ordinal, dl, f0, f1, ...), several a chunk: the single words of all leaves come of one pass over the postings."""
    names = [f"f{k}" for k in range(len(leaves))]
    parts = []
    if words := sorted({x.word for x in leaves if x.word is not None}):
        own = postings.filter(F.col("term").isin(*words))
        f = weight * F.size("positions")
        of = lambda x: (F.col("term") == x.word) & (F.lit(True) if x.columns is None else F.col("col").isin(*x.columns) if x.columns else F.lit(False))
        each = (F.lit(0.0) if x.word is None else F.when(of(x), f).otherwise(0.0) for x in leaves)
        parts.append(own.select("path", "ordinal", "dl", *(c.alias(n) for c, n in zip(each, names, strict=True))))
    for k, x in enumerate(leaves):
        if x.hits is not None:
            parts.append(x.hits.select("path", "ordinal", "dl", *((weight * F.size("positions") if n == f"f{k}" else F.lit(0.0)).alias(n) for n in names)))
    return reduce(DataFrame.unionByName, parts)


def bm25(postings: DataFrame, lengths: DataFrame, node: Node, weights: dict[str, float] | None = None, tokenize: Callable[[str], list[str]] = T.terms, totals: DataFrame | None = None) -> DataFrame:
    """Rows (path, ordinal, score) of the matching chunks; higher is better. Terms must meet within one chunk.

    Every phrase counts as one term. Its frequency is the sum of column weight times hits, a chunk's
    length is its tokens in all columns, and a phrase's document frequency ignores the other phrases.
    All leaves meet in one aggregate by chunk; conditions and scores are expressions over it.
    ``totals`` is a stored row (n, avg) of ``lengths``; without it they are counted.
    """
    weight = F.lit(1.0)
    if unknown := sorted(set(weights or {}) - set(COLUMNS)):
        warnings.warn(f"no columns to weight: {unknown}", stacklevel=2)
    for name, w in (weights or {}).items():
        if name in COLUMNS:
            weight = F.when(F.col("col") == name, F.lit(float(w))).otherwise(weight)
    leaves: list[_Leaf] = []
    scoring: list[int] = []
    matching = _evaluate(postings, node, tokenize, leaves, scoring)
    names = [f"f{k}" for k in range(len(leaves))]
    chunks = _counted(postings, leaves, weight).groupBy("path", "ordinal").agg(F.max("dl").alias("dl"), *(F.sum(n).alias(n) for n in names))
    # with all columns in it this reads what the scores read, so that Spark computes the chunks once
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("dl", *names)))
    found = chunks.agg(*(F.sum((whole & (F.col(f"f{k}") > 0)).cast("long")).alias(f"d{k}") for k in scoring))
    if totals is None:
        totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    # both right sides have one row
    joined = chunks.filter(matching).crossJoin(F.broadcast(found)).crossJoin(F.broadcast(totals.select("n", "avg")))
    score = F.lit(0.0)
    for k in scoring:
        f, d = F.col(f"f{k}"), F.col(f"d{k}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    return joined.select("path", "ordinal", score.alias("score"))


def search(postings: DataFrame, lengths: DataFrame, query: str, scope: str = "all", weights: dict[str, float] | None = None, tokenize: Callable[[str], list[str]] = T.terms) -> DataFrame | None:
    """Scored chunks of a query in a column scope; None for a blank query."""
    node = parse_lenient(query, COLUMNS, SCOPES[scope])
    return None if node is None else bm25(postings, lengths, node, weights, tokenize)


def query_terms(query: str, tokenize: Callable[[str], list[str]] = T.terms) -> set[str]:
    return {t for p in phrases(parse_lenient(query, COLUMNS)) for t in tokenize(p.text)}


def add_snippets(rows: DataFrame, wanted: set[str], n_words: int, content_col: str = "content") -> DataFrame:
    """Column snippet of the few rows that survive a limit."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def cut(content: pd.Series) -> pd.Series:
        return content.map(lambda c: T.snippet(c or "", wanted, n_words))

    return rows.withColumn("snippet", cut(F.col(content_col)))
