"""SentencePiece vocabularies: N-best segmentation over the piece lattice, and decoding.

A forward Viterbi pass gives the best score from the start to every position. Those scores are
exact heuristics for an A* search that walks back from the end, so the search pops complete
segmentations in order of their scores. No piece joins a character to a following word mark, so
the lattice of a text falls apart at word marks: words are solved once and kept, and the N best
of a text combine the N best of the N-1 words with the smallest gap between best and second best.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .arrow_map import map_rows, per_process

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # an unknown character scores so much below the lowest piece
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are solved one by one, along the word, instead of many together.
LONG = 256


class Lattice:
    """The pieces of a vocabulary file with their stored scores; unknown characters fall back to bytes."""

    KEEP, KEEP_CHARACTERS = 400_000, 8_000_000  # words, and characters of words, that are kept

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.unknown = model.trainer_spec.unk_id
        self.text: list[bytes] = []
        scores = []
        for k, p in enumerate(model.pieces):
            scores.append(float(p.score))
            if p.type == p.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
                continue
            normal = p.type in (p.NORMAL, p.USER_DEFINED)
            self.text.append(p.piece.replace(MARK, " ").encode() if normal else b"")
            if normal:
                self.ids[p.piece] = k
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.scores = np.array(scores)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((self.scores[k] for k in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece joins two words; its lattice has no fixed cuts")
        # a newline that is in no longer piece is a fixed cut too
        lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        self.split = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self._index_pieces()
        # of solved words, by number: best ids as 32-bit bytes, score, gap to the second-best segmentation
        self.number: dict[str, int] = {}
        self.best: list[bytes] = []
        self.score, self.gap, self.size = np.empty(0), np.empty(0), np.empty(0, dtype=np.int64)
        self.choices: dict[tuple[int, int], list[tuple[int, ...]]] = {}
        self.nbest_known: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.characters = 0
        self.score_list = self.scores.tolist()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _index_pieces(self) -> None:
        """Hash tables of all pieces: one entry a slot, pieces whose slot is taken go to the next table."""
        self.hashes = np.array([self._hash(p) for p in self.ids] or [0], dtype=np.uint64)
        self.piece_of = np.array([*self.ids.values()] or [-1], dtype=np.int64)
        self.slots: list[np.ndarray] = []
        left = np.arange(len(self.ids))
        while len(left):
            slot = self._slot(self.hashes[left], len(self.slots))
            table = np.zeros(2**20, dtype=np.int32)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            self.slots.append(table)
            left = np.delete(left, first)
            if len(self.slots) > 8:
                raise ValueError("the vocabulary's pieces can't be indexed")

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93 + 2 * table) >> np.uint64(44)).astype(np.int64)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 for none."""
        out = np.full(h.shape, -1, dtype=np.int64)
        for k, table in enumerate(self.slots):
            at = table[self._slot(h, k)]
            hit = self.hashes[at] == h
            out[hit] = self.piece_of[at[hit]]
        return out

    def chunks(self, text: str) -> list[str]:
        """The parts of a text between fixed cuts."""
        if not text:
            return []
        return self.split((MARK if self.prefix else "") + text.replace(" ", MARK))

    def _ids(self, word: str, arcs: list[tuple[int, int]]) -> bytes:
        out: list[int] = []
        for at, n in arcs:
            k = self.ids.get(word[at : at + n])
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in word[at].encode()]
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<u4").tobytes()

    def solve(self, words: list[str]) -> None:
        """Viterbi over all given words at once; keeps what it finds."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG:
                self._solve_long(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            size = max(1, 1_000_000 // (n * min(n, self.longest)))
            for at in range(0, len(own), size):
                self._solve(own[at : at + size], n)

    def _solve_long(self, word: str) -> None:
        """The two best segmentations of a long word, whose matrices would grow with it."""
        (score, ids), *second = self.nbest_word(word, 2)
        self.number[word] = len(self.best)
        self.best.append(ids)
        self.score = np.append(self.score, score)
        self.gap = np.append(self.gap, score - second[0][0] if second else np.inf)
        self.size = np.append(self.size, len(ids))

    def _solve(self, words: list[str], n: int) -> None:
        m, most = len(words), min(n, self.longest)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n).astype(np.uint64).T + np.uint64(1)
        piece = np.full((most, n, m), -1, dtype=np.int64)  # by length less one, and start
        h = np.zeros((n, m), dtype=np.uint64)
        for k in range(most):
            h = h[: n - k] * BASE + codes[k:]
            piece[k, : n - k] = self._look_up(h)
        score = np.where(piece >= 0, self.scores[piece], -np.inf)
        unknown = piece[0] < 0
        score[0][unknown] = self.unknown_score
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        back = np.zeros((n + 1, m), dtype=np.int64)
        rest = np.full((n + 1, m), -np.inf)
        rest[n] = 0.0
        for j in range(1, n + 1):
            for k in range(min(j, most), 0, -1):  # of equal scores the longest last piece wins
                s = best[j - k] + score[k - 1, j - k]
                better = s > best[j]
                best[j] = np.where(better, s, best[j])
                back[j][better] = k
        for i in range(n - 1, -1, -1):
            for k in range(1, min(n - i, most) + 1):
                np.maximum(rest[i], score[k - 1, i] + rest[i + k], out=rest[i])
        off_path = score.copy()
        rows, at, steps = np.arange(m), np.full(m, n), []
        while len(rows):
            k = back[at, rows]
            at = at - k
            off_path[k - 1, at, rows] = -np.inf
            steps.append(np.full(m, -1, dtype=np.int64))
            steps[-1][rows] = piece[k - 1, at, rows]
            live = at > 0
            rows, at = rows[live], at[live]
        second = np.full(m, -np.inf)
        for k in range(1, most + 1):
            np.maximum(second, (best[: n - k + 1] + off_path[k - 1, : n - k + 1] + rest[k:]).max(axis=0), out=second)
        many = np.zeros(m, dtype=np.int64)
        path = np.stack(steps[::-1], axis=1)  # a word's pieces stand at the right end of its row
        cut = np.full(m, n)
        while (live := cut > 0).any():
            many += live
            cut = np.where(live, cut - back[cut, np.arange(m)], 0)
        buffer, width = path.astype("<u4").tobytes(), 4 * path.shape[1]
        with_unknown = unknown.any(axis=0).tolist()
        at_number = len(self.best)
        for r, (w, c) in enumerate(zip(words, many.tolist(), strict=True)):
            end = (r + 1) * width
            self.best.append(self._ids(w, self._arcs(back[:, r], n)) if with_unknown[r] else buffer[end - 4 * c : end])
            self.number[w] = at_number + r
        self.score = np.concatenate([self.score, best[n]])
        self.gap = np.concatenate([self.gap, best[n] - second])
        self.size = np.concatenate([self.size, np.fromiter(map(len, self.best[at_number:]), dtype=np.int64, count=m)])

    @staticmethod
    def _arcs(back: np.ndarray, n: int) -> list[tuple[int, int]]:
        arcs = []
        while n:
            n -= (k := int(back[n]))
            arcs.append((n, k))
        return arcs[::-1]

    def _forward(self, word: str) -> array:
        """Best score from the start of a word to every position."""
        find, score, longest, unknown = self.ids.get, self.score_list, self.longest, self.unknown_score
        out = array("d", [0.0])
        for j in range(1, len(word) + 1):
            piece = find(word[j - 1 : j])
            best = out[j - 1] + (unknown if piece is None else score[piece])
            for i in range(j - 2, max(j - longest, 0) - 1, -1):
                if (piece := find(word[i:j])) is not None and out[i] + score[piece] > best:
                    best = out[i] + score[piece]
            out.append(best)
        return out

    def nbest_word(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one word, best first: forward Viterbi, then A* from the end.

        The forward scores are exact heuristics, so complete paths leave the heap in order. A node's
        arcs enter the heap one by one, best first, and paths are kept as links to their parents; a
        node that n paths have passed needs no more. So memory is of the order of n * length.
        """
        if (found := self.nbest_known.get((word, n))) is not None:
            return found
        find, score = self.ids.get, self.score_list
        forward = self._forward(word)
        arcs: dict[int, bytes] = {}  # by end: lengths, best first, of equal ones the longest
        passed: dict[int, int] = {}
        parent, place, done = array("q", [-1]), array("q", [len(word)]), array("d", [0.0])
        heap: list[tuple] = []
        order = itertools.count()

        def arc_score(at: int, k: int) -> float:
            piece = find(word[at - k : at])
            return self.unknown_score if piece is None else score[piece]

        def push(state: int, i: int) -> None:
            at = place[state]
            if at not in arcs:
                able = [k for k in range(min(at, self.longest), 0, -1) if k == 1 or word[at - k : at] in self.ids]
                arcs[at] = bytes(sorted(able, key=lambda k: -(forward[at - k] + arc_score(at, k))))
            if i < len(arcs[at]):
                k = arcs[at][i]
                heapq.heappush(heap, (-(done[state] + arc_score(at, k) + forward[at - k]), at - k, next(order), state, i))

        out: list[tuple[float, bytes]] = []
        push(0, 0)
        while heap and len(out) < n:
            f, at, _, before, i = heapq.heappop(heap)
            push(before, i + 1)
            k = place[before] - at
            if at and passed.get(at, 0) >= n:
                continue
            passed[at] = passed.get(at, 0) + 1
            parent.append(before)
            place.append(at)
            done.append(done[before] + arc_score(place[before], k))
            if at:
                push(len(place) - 1, 0)
                continue
            path, state = [], len(place) - 1
            while parent[state] >= 0:
                path.append((place[state], place[parent[state]] - place[state]))
                state = parent[state]
            out.append((-f, self._ids(word, path)))
        if len(word) <= LONG:
            if len(self.nbest_known) > self.KEEP // 16:
                self.nbest_known.clear()
            self.nbest_known[word, n] = out
        return out

    def prepare(self, texts: list[list[str]]) -> None:
        """Solve the words of many texts together; words kept from before are dropped once too many."""
        missing = {w for words in texts for w in words if w not in self.number}
        self.characters += sum(map(len, missing))
        if len(self.best) + len(missing) > self.KEEP or self.characters > self.KEEP_CHARACTERS:
            self.number.clear()
            self.best.clear()
            self.score, self.gap, self.size = self.score[:0], self.gap[:0], self.size[:0]
            missing = {w for words in texts for w in words}
            self.characters = sum(map(len, missing))
        if missing:
            self.solve(list(missing))

    def nbest(self, text: str, n: int, words: list[str] | None = None) -> Iterator[tuple[float, bytes, bool]]:
        """Up to n best segmentations of a text, best first: score, ids, and whether they decode to the text.

        ``words`` are its chunks, if they are prepared already.
        """
        if words is None:
            words = self.chunks(text)
            self.prepare([words])
        numbers = list(map(self.number.__getitem__, words))
        ids = b"".join(map(self.best.__getitem__, numbers))
        whole = self.decode(np.frombuffer(ids, dtype="<u4").tolist()) == text
        at = np.array(numbers, dtype=np.int64)
        total, gaps = float(self.score[at].sum()), self.gap[at]
        near = sorted(range(len(words)), key=gaps.tolist().__getitem__)[: n - 1] if len(words) < 64 else self._smallest(gaps, n - 1)
        near = [k for k in near if gaps[k] < np.inf]
        starts = np.concatenate([[0], np.cumsum(self.size[at])])
        lists = [self.nbest_word(words[k], n) for k in near]
        losses = [[own[0][0] - score for score, _ in own] for own in lists]
        if (n, len(lists)) not in self.choices:
            self.choices[n, len(lists)] = choices(n, len(lists))
        ranked = sorted((sum(loss[i] for loss, i in zip(losses, c, strict=True)), c) for c in self.choices[n, len(lists)] if all(i < len(own) for i, own in zip(c, lists, strict=True)))
        for loss, choice in ranked[:n]:
            if not any(choice):
                yield total, ids, whole
                continue
            swapped, same = ids, whole
            for k, own, i in sorted(zip(near, lists, choice, strict=True), key=lambda x: -x[0]):
                if i:
                    swapped = swapped[: starts[k]] + own[i][1] + swapped[starts[k + 1] :]
                    same = same and self._bytes(own[i][1]) == words[k].replace(MARK, " ").encode("utf-8", "surrogatepass")
            yield total - loss, swapped, same

    @staticmethod
    def _smallest(gaps: np.ndarray, n: int) -> list[int]:
        """Places of the n smallest, earlier places first among equals."""
        if not n:
            return []
        limit = np.partition(gaps, n - 1)[n - 1]
        near = np.flatnonzero(gaps <= limit)
        return near[np.argsort(gaps[near], kind="stable")][:n].tolist()

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, word marks as spaces, byte pieces as their bytes, the added first space gone."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def choices(n: int, lists: int) -> list[tuple[int, ...]]:
    """Index choices from ranked lists that can be among the n best: those that fewer than n others dominate."""
    found: list[tuple[int, ...]] = [()]
    for _ in range(lists):
        found = [(*c, i) for c in found for i in range(n) if math.prod(k + 1 for k in c) * (i + 1) <= n]
    return found


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode_nbest(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows (id, rank, score, n_pieces, ids, round_trip): the n best segmentations of every whole text.

    Rank 1 is the best; texts with fewer segmentations have fewer rows. Scores are sums of the
    vocabulary's stored scores. Equal scores: the longer last piece first, then the earlier word.
    Null and empty texts have one segmentation, empty, with score 0. round_trip says whether the
    ids decode to the text (a text that holds the word mark itself decodes to spaces). With
    ``digest`` the column ids is replaced by ids_crc32, over little-endian 32-bit ids. Null ids and
    repeated rows are treated like any other row; an empty table gives no rows. Very long texts are
    read whole, also where they hold no space; memory grows with a text's length in proportion.
    Columns other than the two named are never read, so their names can't clash.
    """
    last = StructField("ids_crc32", LongType()) if digest else StructField("ids", ArrayType(IntegerType()))
    key = _rows(df, id_col, text_col).schema["id"]
    schema = StructType([key, StructField("rank", IntegerType()), StructField("score", DoubleType()), StructField("n_pieces", LongType()), last, StructField("round_trip", BooleanType())])

    def start() -> Callable:
        lattice = per_process(("lattice", model_path), lambda: Lattice(model_path))

        def step(rows: dict[str, list]):
            out: list[tuple] = []
            texts = [text or "" for text in rows["text"]]
            words = list(map(lattice.chunks, texts))
            lattice.prepare(words)
            for key, text, own in zip(rows["id"], texts, words, strict=True):
                for rank, (score, ids, same) in enumerate(lattice.nbest(text, n, own), 1):
                    out.append((key, rank, score, len(ids) // 4, zlib.crc32(ids) if digest else np.frombuffer(ids, dtype="<i4"), same))
            yield dict(zip(schema.fieldNames(), map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in schema.fieldNames()}

        return step

    return map_rows(_rows(df, id_col, text_col), start, schema).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the texts of arrays of ids; a null array gives null. Ids must lie in the vocabulary."""
    from pyspark.sql.types import StringType

    given = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = StructType([given.schema["id"], StructField("text", StringType())])

    def start() -> Callable:
        lattice = Lattice(model_path)

        def step(rows: dict[str, list]):
            yield {"id": rows["id"], "text": [None if ids is None else lattice.decode(ids) for ids in rows["ids"]]}

        return step

    return map_rows(given, start, schema).withColumnRenamed("id", id_col)
