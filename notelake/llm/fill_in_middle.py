"""Fill-in-the-middle transformation: text is cut at two word bounds, and its middle moves to the end.

One Aho-Corasick automaton runs over a text and reports white space and sentinels. Between two
neighbouring events lies either nothing or exactly one run of other characters, so the places
where units end follow from the events' gaps, and a cut is a look-up by rank in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrow_map import map_rows, per_process

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that change the class: units are ``[ ]*[^ ]+|[ ]+`` over these and all others.
SPACE = " \t\n\x0b\x0c\r"
#: Events that are turned into numbers at a time.
EVENTS = 1_000_000

CUT = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


def automaton(sentinels: tuple[str, str, str] = SENTINELS):
    """Reports (last position, 0) for white space and (last position, 1) for a sentinel."""
    import ahocorasick

    if len(set(sentinels)) != 3 or any(not s or s.isspace() for s in sentinels):
        raise ValueError("three different sentinels that aren't white space")
    out = ahocorasick.Automaton()
    for c in SPACE:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


def unit_ends(text: str, machine) -> tuple[np.ndarray, bool]:
    """Ends (code points) of all units in order, and whether the text holds a sentinel.

    Memory is eight bytes a unit; events are taken up in pieces.
    """
    found, marked, before = [], False, -1
    events = chain.from_iterable(machine.iter(text))
    while len(part := np.fromiter(islice(events, 2 * EVENTS), dtype=np.int64)):
        place, kind = part[::2], part[1::2]
        marked |= bool(kind.any())
        place = place[kind == 0]
        if len(place):
            # white space right after white space ends nothing; after a gap it ends the unit in the gap
            found.append(place[np.diff(place, prepend=before) > 1])
            before = place[-1]
    if text:
        found.append(np.array([len(text)], dtype=np.int64))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64), marked


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide over a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_in_middle(df: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output), one a row of ``df``.

    ``n`` counts units. ``rate`` percent of the documents are cut, of those ``spm`` percent give the
    suffix first (form spm), the others the prefix (psm). Empty texts and texts that hold a sentinel
    stay plain, and null counts as empty. A repeated row gives the same row again, a null id decides
    like an id without digits. Whole texts are read, in memory of eight bytes a unit; no row meets
    another. Other columns are never read, so their names can't clash; an empty table gives no rows.
    """

    def start() -> Callable:
        machine = per_process(("middle", sentinels), lambda: automaton(sentinels))
        p, s, m = sentinels

        def step(rows: dict[str, list]):
            out: dict[str, list] = {n: [] for n in CUT.fieldNames()}
            for key, text in zip(rows["id"], rows["text"], strict=True):
                text = text or ""
                ends, marked = unit_ends(text, machine)
                n = len(ends)
                h1, h2, h3, h4 = numbers(key, seed)
                if not text or marked or h3 % 100 >= rate:
                    row = (key, n, "plain", None, None, text)
                else:
                    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    form = "spm" if h4 % 100 < spm else "psm"
                    first = s + text[b:] + p + text[:a] if form == "spm" else p + text[:a] + s + text[b:]
                    row = (key, n, form, a, b - a, first + m + text[a:b])
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            yield out

        return step

    cut = map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), start, CUT)
    return cut.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of that form was made; null for null."""
    part = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels))
    prefix_first, suffix_first = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", prefix_first).when(form == "spm", suffix_first)
