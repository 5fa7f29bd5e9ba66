"""Near-duplicate detection: fast similarity sketches, banding, and exact verification.

A sketch has ``coordinates`` bins. In each round every shingle is hashed to a bin and a value; a
bin keeps the least value of the first round that reached it. Rounds stop once all bins are full;
bins still empty after as many rounds as there are bins take, each in a round of its own, the least
value over all shingles. So every coordinate is filled, and the share of equal coordinates
concentrates around the Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .arrow_map import give_back, map_rows
from .components import connected_components, grown
from .store import materialize, release

SHINGLE = 5
#: Bands and coordinates of each: a pair of similarity 0.8 shares no band with probability 5e-6 (miss_probability).
BANDS, ROWS = 40, 6
#: Bands are verified in runs that end here; after the first run only buckets that span components are left to verify.
RUNS = (2, 8)
#: A document weighs one, and one more for so many shingles, so that groups are bounded in bytes too.
WEIGHED = 2000
#: Weight of the blocks that a large group is cut into, and members that are measured against one hub in one task.
BLOCK = 256
#: Weight of a bucket up to which one task holds it, as it holds two blocks.
LISTED = 2 * BLOCK
#: Times that a large group is measured against one of its members before its blocks meet.
STARS = 1

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, bijective."""
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased, cut at ASCII white space.

    With fewer than k words the whole sequence is one shingle; without words the set is empty.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _G + h[i : i + len(out)])
    return np.unique(out)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: t values (round, least hash)."""
    n = len(elements)
    bins = np.full(t, 2**64 - 1, dtype=np.uint64)
    at, each = 0, max(1, -(-t * 2 // n))
    while at < t:
        rounds = np.arange(at, min(t, at + each), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _G)
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(bins, place.ravel(), (rounds[:, None] << np.uint64(32) | h & np.uint64(2**32 - 1)).ravel())
        if bins.max() < 2**64 - 1:
            return bins
        at += each
        each *= 2
        each = min(each, max(1, 65536 // n))
    for b in np.flatnonzero(bins == 2**64 - 1):
        r = np.array([t + b], dtype=np.uint64)
        bins[b] = (r << np.uint64(32) | (mix(elements + (r + np.uint64(1)) * _G) & np.uint64(2**32 - 1)).min())[0]
    return bins


def band_keys(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = sketch(elements, bands * rows).reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * _G + values[:, i])
    return h.view(np.int64)


SIGNED = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("set_key", BinaryType()), StructField("bands", ArrayType(LongType()))])
SETS = StructType([StructField("id", LongType()), StructField("elements", BinaryType())])
#: A link (a, b), or with the sizes of intersection and union a pair of hub and member that was measured.
FOUND = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("shared", LongType()), StructField("joint", LongType())])
#: Sides of a group's rows: 0 and 1 are blocks whose pairs are verified; a hub is measured against each member.
HUB, MEMBER = 2, 3


def _sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def start() -> Callable:
        import hashlib

        def step(batch: dict[str, list]):
            out: dict[str, list] = {n: [] for n in SIGNED.fieldNames()}
            for key, text in zip(batch["id"], batch["text"], strict=True):
                own = shingles(text, k)
                out["id"].append(key)
                out["n"].append(len(own))
                out["set_key"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                out["bands"].append(band_keys(own, bands, rows) if len(own) and key is not None else None)
            yield out

        return step

    return map_rows(docs, start, SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def start() -> Callable:
        def step(batch: dict[str, list]):
            yield {"id": batch["id"], "elements": [shingles(text, k).astype("<u8").tobytes() for text in batch["text"]]}

        return step

    return map_rows(docs, start, SETS)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, through columns of shared elements, some at a time."""
    m = len(sets)
    if m == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    width = max(64, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((m, width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def links_within(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (id, least id) of the components that pairs of enough similarity form; in a group of two blocks, pairs across."""
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if sides.any() and not sides.all():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, True)
    label = ids.copy()
    while True:
        lower = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    return [(int(a), int(b)) for a, b in zip(ids, label, strict=True) if a != b]


def _together(rows: DataFrame, sets: DataFrame, keys: list[str], schema: StructType, start: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Rows with their sets, those of equal ``keys`` together and in the order of ``side``, through ``start()``.

    That gives two functions: one takes a row (keys, side, id, elements) and one ends the input;
    both return lists of tuples of ``schema``.
    """
    members = rows.join(sets, "id").select(*keys, "side", "id", "elements").repartition(*keys).sortWithinPartitions(*keys, "side")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, end = start()
        for batch in batches:
            out: list[tuple] = []
            *columns, elements = (batch.column(n) for n in (*keys, "side", "id", "elements"))
            for *row, data in zip(*(c.to_pylist() for c in columns), elements, strict=True):
                out += take(tuple(row[: len(keys)]), row[-2], row[-1], np.frombuffer(data.as_buffer(), dtype="<u8"))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in end()], schema=arrow)
        give_back()

    return members.mapInArrow(run, schema)


def _verify(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is found in the groups (grp, side, id), each of which one task works on: rows of ``FOUND``, some repeated.

    Of blocks the task holds all sets, and confirmed links are found. With a hub it holds the hub's set
    and one member's at a time, and every pair is measured; an id with several sets has the largest of
    their similarities.
    """

    def start() -> tuple[Callable, Callable]:
        held: list[tuple] = []
        hubs: list[np.ndarray] = []
        group = None

        def end() -> list[tuple]:
            if len(held) < 2:
                return []
            ids, sides = np.array([r[1] for r in held], dtype=np.int64), np.array([r[0] for r in held], dtype=bool)
            return [(*link, None, None) for link in links_within(ids, sides, [r[2] for r in held], percent)]

        def take(key: tuple, side: int, member: int, elements: np.ndarray) -> list[tuple]:
            nonlocal group
            out = []
            if key != group:
                out, group = end(), key
                held.clear()
                hubs.clear()
            if side == HUB:
                hubs.append((member, elements.copy()))
            elif side == MEMBER:
                found = [(both := np.intersect1d(own, elements, assume_unique=True).size, len(own) + len(elements) - both) for _, own in hubs]
                out.append((hubs[0][0], member, *max(found, key=lambda x: x[0] / x[1])))
            else:
                held.append((side, member, elements))
            return out

        return take, end

    return _together(groups, sets, ["grp"], FOUND, start)


def _links(found: DataFrame, percent: int) -> DataFrame:
    return found.filter(F.col("shared").isNull() | (F.col("shared") * 100 >= F.col("joint") * percent)).select("a", "b")


def _measure(rows: DataFrame) -> DataFrame:
    """Groups (grp, side, id) that measure large groups (grp, id, hub, size) against their hubs.

    Groups of equal hubs are one, and its members are dealt over as many tasks as they need, with the hub in each.
    """
    pairs = rows.groupBy("hub", "id").agg(F.ceil(F.max("size") / BLOCK).cast("int").alias("parts"))  # the hub is in all of its groups
    hub = F.col("id") == F.col("hub")
    part = F.when(hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    dealt = pairs.select("hub", "id", F.when(hub, HUB).otherwise(MEMBER).alias("side"), F.explode(part).alias("part"))
    return dealt.select(F.concat_ws(":", F.lit("h"), F.col("hub").cast("string"), F.col("part").cast("string")).alias("grp"), "side", "id")


def _crossed(rows: DataFrame) -> DataFrame:
    """Groups (grp, side, id) that hold every pair of members of different components in groups (grp, id, weight, component).

    The largest component of a group needs no pairs of its own: its blocks meet the blocks of the
    rest, and those meet each other, two by two. So no task holds a whole group of more than two blocks.
    """
    parts = rows.groupBy("grp", "component").agg(F.sum("weight").alias("n"))
    tops = parts.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size")).filter("size > top.n")
    tops = tops.select("grp", F.col("top.component").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("top_blocks"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int").alias("rest_blocks"), "size")
    rows = materialize(rows.join(materialize(tops, "tops"), "grp").withColumn("in_top", F.col("component") == F.col("top")), "sided")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("in_top"), F.col("top_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    whole = rows.filter(F.col("size") <= LISTED).select(F.concat_ws(":", F.lit("w"), "grp").alias("grp"), F.lit(0).alias("side"), "id")
    rows = rows.filter(F.col("size") > LISTED).withColumn("own", own)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda kind, *at: F.concat_ws(":", F.lit(kind), "grp", *(F.col(c).cast("string") for c in at)).alias("grp")
    top = rows.filter("in_top").withColumn("other", each("rest_blocks")).select(named("x", "own", "other"), F.lit(0).alias("side"), "id")
    rest = rows.filter("not in_top").withColumn("other", each("top_blocks")).select(named("x", "other", "own"), F.lit(1).alias("side"), "id")
    among = rows.filter("not in_top").withColumn("other", each("rest_blocks")).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    among = among.select(named("o", "low", "high"), (F.col("own") > F.col("low")).cast("int").alias("side"), "id")
    return whole.unionByName(top).unionByName(rest).unionByName(among)


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows (grp, id, weight, component) of groups that hold more than one component, with the group's weight ``size`` and least id ``hub``.

    Groups of equal members are one: of equal weight, least id and sums of both halves of their ids' hashes.
    """
    h = F.xxhash64("id")
    groups = rows.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("weight").alias("size"), F.min("id").alias("hub"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("lower"), F.sum(F.shiftright(h, 32)).alias("upper"))
    groups = groups.filter("low < high").groupBy("size", "hub", "lower", "upper").agg(F.min("grp").alias("grp")).select("grp", "size", "hub")
    return rows.join(materialize(groups, "spanning"), "grp")  # a written table, so that a hot group is split or none is shuffled


def _joined(rows: DataFrame, forest: DataFrame | None) -> DataFrame:
    """Rows (grp, id, weight, ...) with their component so far."""
    if forest is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(forest.withColumnRenamed("node", "member"), F.col("id") == F.col("member"), "left").select(*rows.columns, F.coalesce("component", "id").alias("component"))


def _resolve(rows: DataFrame, sets: DataFrame, percent: int, forest: DataFrame | None, metric: bool) -> DataFrame:
    """Components after all links within groups (grp, id, weight) are confirmed.

    Groups that one task holds are verified pair by pair. Beside them, a larger one is measured against
    its smallest id, which links most members of a group of copies at a linear price. Jaccard distance
    is a metric, so members whose distances to that hub differ by more than the threshold can't be
    linked: what still spans components is cut into overlapping shells of that width, and the
    shells go on as groups. At the end the blocks of what is left meet, which is exact.

    A step that shuffles costs every one of its tasks, however few rows there are, so what can go
    through the same join with the sets and the same growth of the forest does.
    """
    rows = rows.select("grp", "id", "weight")
    for _ in range(STARS):
        rows = materialize(_spanning(_joined(rows, forest)), "members")
        groups, large = rows.filter(F.col("size") <= LISTED).select("grp", F.lit(0).alias("side"), "id"), rows.filter(F.col("size") > LISTED)
        if large.isEmpty():
            return forest if forest is not None and rows.isEmpty() else grown(forest, _links(_verify(groups, sets, percent), percent))
        found = materialize(_verify(groups.unionByName(_measure(large)), sets, percent), "found")
        forest = grown(forest, _links(found, percent))
        measured = found.filter("shared is not null").select(F.col("a").alias("hub"), F.col("b").alias("id"), "shared", "joint")
        # the hub itself has met all of its group
        shell = F.floor((1 - F.col("shared") / F.col("joint")) / (1.000001 - percent / 100)) if metric and percent < 100 else F.lit(0)
        rows = large.filter("id <> hub").join(measured, ["hub", "id"]).select("grp", "id", "weight", shell.alias("shell"))
        both = F.array("shell", F.col("shell") - 1) if metric and percent < 100 else F.array("shell")
        rows = rows.withColumn("shell", F.explode(both)).select(F.concat_ws("/", "grp", F.col("shell").cast("string")).alias("grp"), "id", "weight")
    crossed = materialize(_joined(rows, forest), "members")
    return grown(forest, _links(_verify(_crossed(crossed), sets, percent), percent))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A & B| >= percent * |A | B| over their sets of k-word
    shingles (64-bit hashes); component_id is the smallest id reachable over links, and the row that
    has it is kept. Equal sets are one node. Bands name candidates; every link is confirmed on whole sets.

    Defined cases: a null or empty text has no shingles and is linked with nothing. A row with a null
    id takes no part: component_id is null and it is kept. Rows that repeat an id are one node, linked
    with all that any of them is linked with. Very long texts weigh more in a group, so that fewer of
    them meet in a task. An empty table gives no rows. Other columns are never read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(_sign(docs, k, bands, rows), "signed")
    nodes = signed.filter("set_key is not null and id is not null")
    firsts = materialize(nodes.groupBy("set_key").agg(F.min("id").alias("node")), "sets")
    own = signed.join(firsts, "set_key", "left").select("id", "n", "node", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands"))
    own = materialize(own, "nodes")
    release(signed)

    # buckets with one member only fall away before anything is paired
    weight = (F.col("n") / WEIGHED).cast("int") + 1
    banded = own.filter("bands is not null").select(F.posexplode("bands").alias("at", "band"), "id", weight.alias("weight"))
    shared = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("band"), "buckets")
    candidates = materialize(banded.join(shared, "band").select("at", F.col("band").cast("string").alias("grp"), "id", "weight"), "candidates")
    wanted = candidates.select("id").distinct()
    # merged at every size: the table of wanted ids grows with the input; its tasks hold buckets of ids already
    sets = materialize(_sets(docs.join(wanted.hint("merge"), "id"), k), "elements", "id")

    repeated = own.filter("bands is not null").groupBy("id").count().filter("count > 1").select("id")
    once = repeated.isEmpty()
    ends = [*(r for r in RUNS if r < bands), bands]
    forest = None
    for low, high in zip([0, *ends], ends, strict=False):
        forest = _resolve(candidates.filter((F.col("at") >= low) & (F.col("at") < high)), sets, percent, forest, once)
    release(sets, candidates)
    found = forest.select(F.col("node").alias("a"), F.col("component").alias("b"))
    # an id with several sets ties those sets' nodes
    if not once:
        tied = own.filter("node is not null and id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
        found = found.unionByName(tied.join(own.filter("bands is not null").select(F.col("id").alias("a")).distinct(), "a", "left_semi"))
        forest = connected_components(found)
    out = own.join(forest.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of this similarity shares no band."""
    return math.pow(1 - similarity**rows, bands)
