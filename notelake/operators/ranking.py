"""Score adjustments, fusion and collapse of ranked chunk rows (path, ordinal, heading, score, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import in_folder

RRF, DOWNWEIGHT = 60, 0.25
# The factors of maintained-metadata ranking, and the files that only navigate.
DEPRECATED_WEIGHT, STALE_WEIGHT, RESERVED_WEIGHT = 0.5, 0.75, 0.5
RESERVED_FILES = ("index.md", "log.md")


def length_downweight(rows: DataFrame, alpha: float = DOWNWEIGHT) -> DataFrame:
    """score / (1 + alpha ln(chunk_count)); notes of one chunk keep theirs."""
    n = F.greatest(F.coalesce(F.col("chunk_count"), F.lit(1)), F.lit(1))
    return rows.withColumn("score", F.col("score") / (1 + alpha * F.log(n.cast("double"))))


def folder_boost(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Positive scores times the weight of the deepest folder prefix that holds the note."""
    factor = F.lit(1.0)
    for folder in sorted(weights, key=len):  # the deepest is asked first
        factor = F.when(in_folder(F.col("folder"), folder), F.lit(float(weights[folder]))).otherwise(factor)
    return rows.withColumn("score", F.when(F.col("score") > 0, F.col("score") * factor).otherwise(F.col("score")))


def is_reserved(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "").isin(*RESERVED_FILES)


def okf_downweight(rows: DataFrame, status: Column | None = None, stale: Column | None = None) -> DataFrame:
    """Positive scores times the factors of deprecated, stale and reserved notes."""
    status = F.col("status") if status is None else status
    stale = F.col("stale") if stale is None else stale
    one = F.lit(1.0)
    factor = F.when(status == "deprecated", DEPRECATED_WEIGHT).otherwise(one) * F.when(stale, STALE_WEIGHT).otherwise(one) * F.when(is_reserved(F.col("path")), RESERVED_WEIGHT).otherwise(one)
    return rows.withColumn("score", F.when(F.col("score") > 0, F.col("score") * factor).otherwise(F.col("score")))


def candidate_pool(limit: int, per_note: int, semantic: bool = False, filtered: bool = False) -> int:
    """How many rows a channel looks at where results must match a bounded pool."""
    size = max(1000, limit * (per_note + 4)) if semantic else max(limit * (per_note + 4), 50)
    return max(size * 4, 200) if filtered else size


def collapse(rows: DataFrame, limit: int, per_note: int = 2) -> DataFrame:
    """At most ``per_note`` rows of each of ``limit`` notes; notes stand in the order of their best rows."""
    own = Window.partitionBy("path").orderBy(F.desc("score"), F.asc("ordinal"))
    kept = rows.withColumn("note_rank", F.row_number().over(own)).filter(F.col("note_rank") <= per_note)
    # a note's few rows travel as one, so that notes are ordered without a second look at the hits
    packed = F.sort_array(F.collect_list(F.struct("note_rank", *(c for c in rows.columns if c != "path"))))
    notes = kept.groupBy("path").agg(F.max("score").alias("_best"), packed.alias("_rows")).orderBy(F.desc("_best"), "path").limit(limit)
    top = notes.withColumn("file_rank", F.row_number().over(Window.orderBy(F.desc("_best"), "path")))  # over limit rows
    return top.select("path", F.explode("_rows").alias("_row"), "file_rank").select("path", "_row.*", "file_rank").orderBy("file_rank", "note_rank")


def ranked(rows: DataFrame, channel: str, limit: int | None) -> DataFrame:
    """The best ``limit`` rows of a channel, or all, with their rank from 1."""
    order = (F.desc("score"), F.asc("path"), F.asc("ordinal"))
    if limit is None:
        return _ranked_all(rows.orderBy(*order)).withColumn("channel", F.lit(channel))
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("channel", F.lit(channel))


def _ranked_all(ordered: DataFrame) -> DataFrame:
    """Sorted rows with ``rank``: the place in the partition plus the sizes of the partitions before, which alone reach the driver."""
    at = F.col("_at")
    placed = ordered.withColumn("_at", F.monotonically_increasing_id()).persist()  # both uses see one partitioning
    part = F.shiftright(at, 33).cast("int")
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0]
    for k in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(k, 0))
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>")
    return placed.withColumn("rank", at.bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.element_at(offsets, part + 1)).drop("_at")


def rrf(channels: list[DataFrame], k: int = RRF) -> DataFrame:
    """Rows (path, heading, score, search_type, ordinal): sum of 1 / (k + rank) per path and heading over ranked channels.

    Keys that recur within a channel add up. The payload is that of the first channel that has the
    key, at its best rank; search_type names the channels.
    """
    more = [c for c in ("folder",) if all(c in x.columns for x in channels)]  # the same in all rows of a note
    both = reduce(DataFrame.unionByName, (c.select("path", "heading", "ordinal", "rank", "channel", *more, F.lit(n).alias("_c")) for n, c in enumerate(channels)))
    # null headings are a key of their own
    fused = both.groupBy("path", "heading").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min_by("ordinal", F.struct("_c", "rank")).alias("ordinal"),
        F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("search_type"),
        *(F.max(c).alias(c) for c in more),
    )
    return fused


def hybrid(keyword: DataFrame, semantic: DataFrame, limit: int, per_note: int = 2, alpha: float = DOWNWEIGHT, boosts: dict[str, float] | None = None, pool: int | None = None, whole: bool = False) -> DataFrame:
    """Both channels downweighted by length, fused, boosted and collapsed; ``whole`` ranks all rows, without a pool.

    Channel rows need path, ordinal, heading, folder, chunk_count and score.
    """
    pool = None if whole else pool or candidate_pool(limit, per_note, semantic=True)
    channels = [ranked(length_downweight(c, alpha), name, pool) for name, c in (("keyword", keyword), ("semantic", semantic))]
    fused = rrf(channels)
    return collapse(folder_boost(fused, boosts) if boosts else fused, limit, per_note)


def assemble(rows: DataFrame) -> DataFrame:
    """One row per note: score of its best section, and the sections as an array, best first."""
    section = F.struct(F.negative("score").alias("order"), "ordinal", "heading", "score")
    return rows.groupBy("path").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(section)).alias("sections")).orderBy(F.desc("score"), "path")


def resolve_mode(mode: str, has_vectors: bool) -> str:
    """Explicit modes hold; auto is hybrid where there are vectors, else keyword."""
    if mode not in ("auto", "keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "auto":
        return "hybrid" if has_vectors else "keyword"
    return mode
