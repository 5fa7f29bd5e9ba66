"""Packing by cutting a stream of documents into windows, in order, at the cheapest places.

Documents of a partition make one stream of tokens. A dynamic programme chooses the cuts: a window
costs its padding and something for being one, a cut costs nothing at a document's end, little at
a sentence's end and more inside a sentence. The best start of a window that ends at a place is the
minimum over a sliding range, which a monotone queue gives in constant time on average; windows of
a power of two need no padding and are looked up one by one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow_map import map_rows, per_process
from .packing import WordEncoder
from .store import materialize

WINDOW, END = 2048, 1
#: Tokens of a stream that are cut at a time; the last window of a part goes on into the next one.
PART = 262_144
# Words that end a sentence, with what may close after them.
CLOSING = re.compile("[.!?…。！？؟।]+[\"')\\]»”’]*")

PIECES = StructType([StructField(n, LongType()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")])


@dataclass(frozen=True)
class Costs:
    """What cuts and windows cost, in tokens of padding."""

    sentence: int = 2
    inside: int = 24
    window: int = 48
    step: int = 32  # cuts inside a sentence lie this far apart


class SentenceEnds:
    """Places in a document's ids after which a sentence ends: closing punctuation that isn't inside a number."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters, see ``Merges``
        letters = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.closing, self.digit = np.zeros(max(ids.values()) + 1, dtype=bool), np.zeros(max(ids.values()) + 1, dtype=bool)
        for word, k in ids.items():
            if word.endswith("</w>") and all(c in letters for c in word[:-4]):
                text = bytes(letters[c] for c in word[:-4]).decode("utf-8", "replace")
                self.closing[k], self.digit[k] = bool(CLOSING.fullmatch(text)), text.isnumeric()

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.closing[ids[:-1]])
        within = (at > 0) & self.digit[ids[np.maximum(at - 1, 0)]] & self.digit[ids[at + 1]]
        return at[~within] + 1


def cheapest(places: np.ndarray, prices: np.ndarray, window: int, costs: Costs) -> list[int]:
    """The places (indices, ascending) at which cuts cost least in all; the last place is one of them.

    ``places`` ascend, lie at most ``window`` apart and the first is over 0, the stream's begin.
    """
    at = np.concatenate([[0], places])
    # starts from which a window is a power of two, gathered by their end
    ends, starts = [], []
    for k in range(window.bit_length()):
        if (1 << k) < window:
            to = np.searchsorted(at, at - (1 << k))
            hit = np.flatnonzero(at[to] == at - (1 << k))
            ends.append(hit)
            starts.append(to[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    starts = starts[order].tolist()
    first = np.searchsorted(ends[order], np.arange(len(at) + 1)).tolist()
    at, price, n = at.tolist(), [0, *(prices + costs.window).tolist()], len(at)
    total, back, keys = [0] * n, [0] * n, [0] * n  # key: total + place, which padding compares
    queue, head, tail = [0] * n, 0, 1
    for j in range(1, n):
        here = at[j]
        while at[queue[head]] < here - window:
            head += 1
        best = queue[head]
        least = keys[best] + window - here
        a, b = first[j], first[j + 1]
        while a < b:
            i = starts[a]
            if total[i] < least:
                least, best = total[i], i
            a += 1
        total[j] = least = least + price[j]
        back[j] = best
        keys[j] = key = least + here
        while tail > head and keys[queue[tail - 1]] >= key:
            tail -= 1
        queue[tail] = j
        tail += 1
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class Stream:
    """Takes documents up one by one and yields rows of pieces once their windows are settled."""

    def __init__(self, window: int, costs: Costs, part: int = PART) -> None:
        self.window, self.costs, self.part = window, costs, max(part, 2 * window)
        self.docs: list[list] = []  # [id, ids, begin in the stream], the begin may lie before it
        self.places, self.prices = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        self.tokens = self.done = 0  # in the stream; windows given out

    def add(self, key: int | None, ids: bytes, ends: np.ndarray) -> Iterator[tuple]:
        n = len(ids) // 4
        self.docs.append([key, ids, self.tokens])
        for begin in range(0, n, self.part):
            stop = min(begin + self.part, n)
            own = ends[(ends > begin) & (ends < stop)] - begin
            bounds, size = np.concatenate([own, [stop - begin]]), stop - begin
            price = np.full(len(bounds), self.costs.sentence, dtype=np.int64)
            price[-1] = 0 if stop == n else self.costs.inside
            if np.diff(bounds, prepend=0).max() > self.costs.step:  # no bound for long: cuts inside
                grid = np.setdiff1d(np.arange(self.costs.step, size, self.costs.step), bounds)
                near = np.searchsorted(bounds, grid)
                grid = grid[bounds[near] - np.concatenate([[0], bounds])[near] > self.costs.step]
                bounds, price = np.concatenate([bounds, grid]), np.concatenate([price, np.full(len(grid), self.costs.inside)])
                order = np.argsort(bounds)
                bounds, price = bounds[order], price[order]
            self.places.append(bounds + self.tokens)
            self.prices.append(price)
            self.tokens += size
            if self.tokens >= self.part:
                yield from self._settle(False)

    def close(self) -> Iterator[tuple]:
        """The rest. Close to the end every token is a place to cut, as the last window finds no more tokens to fill it."""
        if self.tokens:
            places, prices = np.concatenate(self.places), np.concatenate(self.prices)
            fine = np.setdiff1d(np.arange(max(1, self.tokens - 2 * self.window), self.tokens), places)
            places, prices = np.concatenate([places, fine]), np.concatenate([prices, np.full(len(fine), self.costs.inside)])
            order = np.argsort(places)
            self.places, self.prices = [places[order]], [prices[order]]
            yield from self._settle(True)

    def _settle(self, last: bool) -> Iterator[tuple]:
        places, prices = np.concatenate(self.places), np.concatenate(self.prices)
        cuts = [int(places[k]) for k in cheapest(places, prices, self.window, self.costs)]
        if not last:
            cuts.pop()
        at, begin = 0, 0
        for stop in cuts:
            while at < len(self.docs) and self.docs[at][2] < stop:
                key, ids, own = self.docs[at]
                a, b = max(begin, own), min(stop, own + len(ids) // 4)
                yield key, a - own, b - a, zlib.crc32(memoryview(ids)[4 * (a - own) : 4 * (b - own)]), len(ids) // 4, self.done, a - begin
                if b < own + len(ids) // 4:
                    break
                at += 1
            self.done += 1
            begin = stop
        self.docs = [[key, ids, own - begin] for key, ids, own in self.docs[at:]]
        left = places > begin
        self.places, self.prices, self.tokens = [places[left] - begin], [prices[left]], self.tokens - begin


def pack_windows(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, costs: Costs = Costs(), part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and cut: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row a piece.

    Every document is its ids and ``end``. Documents keep the order they have in the input's
    partitions, and each partition is a stream of its own, so nothing is shuffled and no key can be
    hot; a window holds consecutive tokens of one stream. ``part`` tokens are cut at a time, in memory in proportion,
    whatever the length of a document; only the ids of the documents in them are held whole.

    Null texts count as empty and give the one id ``end``. Null ids and repeated rows are packed
    like any other row, each on its own. Other columns are never read, so their names can't clash.
    An empty table gives no rows. The pieces are written once, so that all later reads see one cutting.
    """

    def start() -> Callable:
        encoder, sentences = per_process(("cuts", tokenizer_path), lambda: (WordEncoder(tokenizer_path), SentenceEnds(tokenizer_path)))
        stream, tail = Stream(window, costs, part), end.to_bytes(4, "little")

        def rows_of(pieces: Iterator[tuple]) -> Iterator[dict[str, list]]:
            found = list(pieces)
            if found:
                yield dict(zip(PIECES.fieldNames(), map(list, zip(*found, strict=True)), strict=True))

        def step(rows: dict[str, list] | None):
            if rows is None:
                yield from rows_of(stream.close())
                return
            for key, ids in zip(rows["id"], encoder.encode([text or "" for text in rows["text"]]), strict=True):
                ids += tail
                yield from rows_of(stream.add(key, ids, sentences.of(np.frombuffer(ids, dtype="<u4"))))

        return step

    pieces = map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), start, PIECES, closing=True)
    numbered = pieces.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("window"))
    return materialize(numbered.drop("window"), "windows").select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
