"""Best-fit packing of documents into fixed-length token sequences by minimum bin slack.

The decision needs only the number of pieces of each length, at most ``capacity`` counts, so
the driver packs that histogram: per bin, a bitset subset-sum over the lengths still available
finds the fullest combination, which is removed as often as the counts allow. Pieces then take
their places by rank within their length.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .arrow_map import map_rows, per_process
from .store import materialize

CAPACITY, END = 4096, 1
#: Pieces of one length are ranked in so many buckets at least, and in more so that a bucket of a
#: length has some BUCKET_ROWS rows at most: no length meets in one task.
BUCKETS, BUCKET_ROWS = 256, 1_000_000

# Text of these characters only needs no normalisation but lower case, which is the same everywhere.
PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(160, 256)])
# Classes of these characters as the vocabulary's own pattern of words has them: runs of letters,
# single digits, runs of all else but white space. Its endings after an apostrophe.
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.array([LETTER if chr(b).isalpha() else DIGIT if chr(b).isnumeric() else SPACE if chr(b).isspace() else OTHER for b in range(256)], dtype=np.uint8)
ENDINGS_1, ENDINGS_2 = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


class Merges:
    """Byte-pair merging of many words at once, by the vocabulary's own table of merges.

    Words of one length are rows of a matrix of ids. Each round joins in every row the leftmost
    pair of the least rank and looks up the two new pairs, until no row holds a known pair.
    """

    ROWS = 4_000  # words in a matrix
    LONGEST = 64  # bytes; longer words go through the tokenizer
    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("the vocabulary isn't one of words with ends")
        ids = model["vocab"]
        # byte-level letters: printable Latin-1 stands for itself, the other bytes for 256 and up, in order
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        letters = [chr(b) if b in kept else None for b in range(256)]
        others = iter(range(256, 512))
        letters = [c or chr(next(others)) for c in letters]
        self.inner = np.array([ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([ids[c + "</w>"] for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.uint64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.tables: list[np.ndarray] = []  # a merge whose slot is taken goes to the next table
        left = np.arange(len(pairs))
        while len(left):
            slot = self._slot(self.keys[left], len(self.tables))
            table = np.zeros(2**18, dtype=np.int32)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93 + 2 * table) >> np.uint64(46)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE for pairs that aren't merged or that hold -1."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(keys.shape, self.NONE, dtype=np.int32)
        for k, table in enumerate(self.tables):
            at = table[self._slot(keys, k)]
            np.copyto(out, at, where=self.keys[at] == keys)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, a row each, and how many of a row count."""
        n, m = len(words[0]), len(words)
        tokens = self.inner[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(m, n)]
        tokens[:, -1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)]
        many = np.full(m, n)
        if n > 1:
            ranks, rows, own = self.ranks(tokens[:, :-1], tokens[:, 1:]), np.arange(m), tokens
            while True:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                live = best < self.NONE
                if not live.all():
                    tokens[rows, :] = own
                    rows, own, ranks, at, best = rows[live], own[live], ranks[live], at[live], best[live]
                    if not len(rows):
                        break
                line = np.arange(len(rows))
                own[line, at] = self.made[best]
                # what stands after the joined pair moves up by one
                moved = np.concatenate([own[:, 1:], np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
                own = np.where(np.arange(n) > at[:, None], moved, own)
                shifted = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), self.NONE, dtype=np.int32)], axis=1)
                ranks = np.where(np.arange(n - 1) >= at[:, None], shifted, ranks)
                many[rows] -= 1
                right = np.minimum(at, n - 2)
                ranks[line, right] = np.where(at < n - 1, self.ranks(own[line, right], own[line, right + 1]), ranks[line, right])
                left = np.maximum(at - 1, 0)
                ranks[line, left] = np.where(at > 0, self.ranks(own[line, left], own[line, left + 1]), ranks[line, left])
        return tokens, many


class WordEncoder:
    """Token ids as little-endian 32-bit bytes, with the ids of seen words kept.

    Plain texts are cut into words by the classes of their characters, many texts at once, and each
    distinct word is encoded once. Words are found by a 64-bit hash, one-to-one up to 8 characters,
    and compared character by character with the word kept under it. Other texts (characters outside the
    plain range, a possible special token, a word over ``Merges.LONGEST``, a word whose hash another
    word has) go through the tokenizer whole, which gives the same ids.
    """

    KEEP = 1_000_000  # words; some 80 MB
    WIDE = Merges.LONGEST // 2  # characters; one has two bytes at most

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.number = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # sorted, and the words' numbers
        self.ids = np.empty(0, dtype="<u4")  # of all kept words, one after another
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.chars = np.empty((0, self.WIDE // 8), dtype="<u8")  # of all kept words, eight to a number, zeros after the last

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(text: str) -> bytes | None:
        """A plain text in lower case, a byte a character."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if data.translate(None, PLAIN) or b"<|" in data else data.translate(LOWER)

    @staticmethod
    def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the words of lower-cased plain text that ends with white space."""
        kind = KIND[data]
        change = np.empty(len(data), dtype=bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= kind == DIGIT  # every digit is a word
        # an apostrophe on its own takes the ending after it along
        quotes = np.flatnonzero(data == ord("'"))
        quotes = quotes[change[quotes] & (kind[np.minimum(quotes + 1, len(data) - 1)] == LETTER)]
        if len(quotes):
            one, two = data[quotes + 1], data[np.minimum(quotes + 2, len(data) - 1)]
            taken = np.isin(one, ENDINGS_1) * 1
            for a, b in ENDINGS_2:
                taken[(one == a) & (two == b)] = 2
            quotes, taken = quotes[taken > 0], taken[taken > 0]
            change[quotes + 1] = False
            change[quotes + 1 + taken] = True
        at = np.flatnonzero(change)
        ends = np.append(at[1:], len(data))
        word = kind[at] != SPACE
        return at[word], (ends - at)[word]

    @staticmethod
    def _lane(data: bytes, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Characters 8 k to 8 k + 7 of words that have some, as numbers."""
        eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        left = np.minimum(sizes - 8 * k, 8).astype(np.uint64)
        return eights[starts + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(8) - left) * np.uint64(8))

    @classmethod
    def _hash(cls, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), dtype=np.uint64)
        rows, k = np.arange(len(starts)), 0
        while len(rows):
            x = (h[rows] ^ cls._lane(data, starts[rows], sizes[rows], k)) * np.uint64(0x9E3779B97F4A7C15)
            h[rows] = x ^ x >> np.uint64(29)
            k += 1
            rows = rows[sizes[rows] > 8 * k]
        return h

    def _strangers(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Words (places) that aren't the kept words of these numbers, though their hashes are equal."""
        width = np.clip((sizes + 7) // 8, 1, None)
        # zeros fill the last eight and stand in no word, so eights that are equal are equal words
        wrong = (self.chars != 0).sum(axis=1)[number] != width
        rows, k = np.flatnonzero((width > 1) & ~wrong), 0
        while len(rows):
            wrong[rows] |= self._lane(data, starts[rows], sizes[rows], k) != self.chars[number[rows], k]
            k += 1
            rows = rows[sizes[rows] > 8 * k]
        return np.flatnonzero(wrong)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for k, word in enumerate(words):
            data = word if word.isascii() else word.decode("latin-1").encode()
            own = by_length.setdefault(len(data), ([], []))
            own[0].append(k)
            own[1].append(data)
        ids, sizes, order = [self.ids], [self.size], []
        for places, own in by_length.values():
            order += places
            for at in range(0, len(own), Merges.ROWS):
                tokens, many = self.merges.encode(own[at : at + Merges.ROWS])
                ids.append(tokens[np.arange(tokens.shape[1]) < many[:, None]].astype("<u4"))
                sizes.append(many)
        known = np.concatenate([self.hashes, hashes])
        number = np.empty(len(known), dtype=np.int64)
        number[: len(self.number)] = self.number
        number[len(self.number) + np.array(order, dtype=np.int64)] = np.arange(len(self.number), len(known))
        line = np.argsort(known, kind="stable")
        self.hashes, self.number = known[line], number[line]
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        chars = np.frombuffer(b"".join(words[k].ljust(self.WIDE, b"\0") for k in order), dtype="<u8")
        self.chars = np.concatenate([self.chars, chars.reshape(len(order), -1)])

    def _together(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of plain texts; None for those with too long a word or one whose hash another word has."""
        data = b"\n".join(texts) + b"\n       "
        starts, sizes = self._cut(np.frombuffer(data, dtype=np.uint8))
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        last = np.searchsorted(starts, ends)  # words before the end of each text
        first = np.append(0, last[:-1])
        wide = np.flatnonzero(sizes > self.WIDE)
        sizes = np.minimum(sizes, self.WIDE)
        distinct, sample, which = np.unique(self._hash(data, starts, sizes), return_index=True, return_inverse=True)
        if len(self.hashes) > self.KEEP:
            self._forget()
        missing = ~np.isin(distinct, self.hashes, assume_unique=True)
        if missing.any():
            at, n = starts[sample[missing]].tolist(), sizes[sample[missing]].tolist()
            self._learn(distinct[missing], [data[a : a + c] for a, c in zip(at, n, strict=True)])
        number = self.number[np.searchsorted(self.hashes, distinct)][which]
        strange = np.concatenate([wide, self._strangers(data, starts, sizes, number)])
        outside = set(np.searchsorted(last, strange, side="right").tolist())
        size = self.size[number]
        total = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(self.start[number] - total[:-1], size) + np.arange(total[-1])]
        return [None if k in outside else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(total[first].tolist(), total[last].tolist(), strict=True))]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = list(map(self._plain, texts))
        found = iter(self._together([p for p in plain if p is not None]) if any(plain) else [b""] * len(plain))
        out = [None if p is None else next(found) for p in plain]
        others = iter(self.whole([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(others) if ids is None else ids for ids in out]


PIECES = StructType([StructField("id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())])


def cut_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids, then ``end``, cut only if longer than ``capacity``.

    Null text counts as empty and gives the one id ``end``.
    """

    def start() -> Callable:
        encoder, tail = per_process(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path)), end.to_bytes(4, "little")

        def step(rows: dict[str, list]):
            out: dict[str, list] = {n: [] for n in PIECES.fieldNames()}
            for key, ids in zip(rows["id"], encoder.encode([text or "" for text in rows["text"]]), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield out

        return step

    return map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), start, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``: length -> how many."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        most, take = min(counts[length], room // length), 1
        while most:  # powers of two make up every number of copies
            take = min(take, most)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                layers.append((length, take, reach))
                reach = grown
            most -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> how many, number of such bins). Each bin starts with the longest piece left."""
    left = {n: c for n, c in counts.items() if c}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        own = fullest(left, capacity - longest)
        left[longest] += 1
        own[longest] = own.get(longest, 0) + 1
        times = min(left[n] // c for n, c in own.items())
        for n, c in own.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        bins.append((own, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, by rank: (first rank, how many in a bin, first bin, offset of the first in a bin)."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: dict[int, int] = {}
    first = 0
    for own, times in bins:
        offset = 0
        for length in sorted(own, reverse=True):
            table.setdefault(length, []).append((ranked.get(length, 0), own[length], first, offset))
            ranked[length] = ranked.get(length, 0) + own[length] * times
            offset += own[length] * length
        first += times
    return table


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table with columns id, piece and length (1 to ``capacity``).

    The table must be stored, as it is read more than once. Its histogram, ``capacity`` counts
    at most, goes to the driver, and the places, at most a few for each bin pattern, to all tasks.
    An empty table gives no rows. Pieces of equal length are interchangeable.
    """
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    keyed = pieces.withColumn("__nl_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = materialize(keyed.groupBy("length", "__nl_bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = places(minimum_bin_slack(histogram, capacity))
    starts = {n: [s[0] for s in own] for n, own in table.items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__nl_bucket")) - F.col("n")
    offsets = counts.select("length", "__nl_bucket", before.alias("__nl_before"))
    rank = F.row_number().over(Window.partitionBy("length", "__nl_bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("__nl_rank", rank).join(offsets, ["length", "__nl_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__nl_rank") + F.col("__nl_before")).alias("rank"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def start() -> Callable:
        def step(rows: dict[str, list]):
            bins, offsets = [], []
            for length, rank in zip(rows["length"], rows.pop("rank"), strict=True):
                from_rank, many, first, offset = table[length][bisect_right(starts[length], rank) - 1]
                k = rank - from_rank
                bins.append(first + k // many)
                offsets.append(offset + k % many * length)
            yield rows | {"sequence_id": bins, "offset": offsets}

        return step

    return map_rows(ranked, start, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and repeated rows are packed like any other row, each on its own. Null and empty texts
    give the one id ``end``. Very long texts are cut into pieces; a task holds one batch of texts and
    their ids. Pieces of equal length are ranked by id, piece and checksum; those that tie in all
    three are interchangeable. An empty table gives no rows. Other columns are never read, so their
    names can't clash.
    """
    pieces = materialize(cut_pieces(df, tokenizer_path, capacity, end, id_col, text_col), "pieces")
    packed = pack(pieces, capacity)
    return packed.withColumnRenamed("id", id_col)
