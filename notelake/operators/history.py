"""Commit history, change sets and packing of texts under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import in_folder, folder_of
from ..model import InvalidRequest


def history(commits: DataFrame, path: str | None = None, folder: str | None = None, since: float | None = None, until: float | None = None, limit: int = 20) -> DataFrame:
    """Commits newest first that touch a note, a folder or anything; both bounds inclusive; limit 1 to 100."""
    if not 1 <= limit <= 100:
        raise InvalidRequest("limit must be 1 to 100")
    out = commits
    if path is not None:
        out = out.filter(F.array_contains("paths", path))
    if folder is not None:
        out = out.filter(F.exists("paths", lambda p: in_folder(folder_of(p), folder)))
    if since is not None:
        out = out.filter(F.col("committed_at") >= since)
    if until is not None:
        out = out.filter(F.col("committed_at") <= until)
    return out.orderBy(F.desc("committed_at"), "sha").limit(limit)


def by_day(commits: DataFrame) -> DataFrame:
    """Rows (day, commits): each UTC day's subjects, newest day and newest commit first."""
    day = F.date_format(F.timestamp_seconds(F.floor("committed_at")), "yyyy-MM-dd")
    entry = F.struct(F.negative("committed_at").alias("order"), "sha", "subject")
    return commits.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_commits"), F.sort_array(F.collect_list(entry)).alias("commits")).orderBy(F.desc("day"))


def change_set(before: DataFrame, after: DataFrame, hash_col: str = "content_hash", excluded: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """Rows (path, change) of two states: added, modified, deleted, unchanged.

    Paths that are excluded now are withheld from deleted; unreadable ones count as unchanged.
    """
    old = before.select("path", F.col(hash_col).alias("_old"))
    new = after.select("path", F.col(hash_col).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    out = old.join(new, "path", "full_outer").select("path", change.alias("change"))
    if unreadable is not None:
        held = unreadable.select("path").withColumn("_held", F.lit(True))
        out = out.join(held, "path", "left").withColumn("change", F.when(F.col("_held") & (F.col("change") == "deleted"), "unchanged").otherwise(F.col("change"))).drop("_held")
    if excluded is not None:
        gone = excluded.select("path").withColumn("_gone", F.lit(True))
        out = out.join(gone, "path", "left").filter(~(F.coalesce("_gone", F.lit(False)) & (F.col("change") == "deleted"))).drop("_gone")
    return out


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def pack(texts: list[tuple[str, int]], budget: int) -> list[list[str]]:
    """Greedy groups in order, each under the budget; what alone is over it stands alone."""
    groups: list[list[str]] = []
    size = budget + 1
    for name, n in texts:
        if size + n > budget:
            groups.append([])
            size = 0
        groups[-1].append(name)
        size += n
    return groups


def pack_within(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``rows`` with column ``pack``: greedy groups within each key, in order, under the budget.

    A group's rows meet in one task, which holds only a running sum.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*rows.schema.fields]).add("pack", IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, number = None, 0, -1
        for batch in batches:
            out = []
            for own, n in zip(batch[key], batch[size], strict=True):
                if own != at:
                    at, used, number = own, budget + 1, -1
                if used + n > budget:
                    number, used = number + 1, 0
                used += n
                out.append(number)
            yield batch.assign(pack=out)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def summarize(texts: dict[str, str], summarizer, budget: int, instruction: str = "Summarize.") -> str:
    """Summaries of packed groups, packed and summarized again until one is left."""
    parts = list(texts.values())
    while True:
        names = [str(k) for k in range(len(parts))]
        groups = pack([(n, len(p)) for n, p in zip(names, parts, strict=True)], budget)
        reduced = [summarizer(instruction, "\n\n".join(parts[int(n)] for n in g)) for g in groups]
        if len(reduced) <= 1:
            return reduced[0] if reduced else ""
        if len(reduced) >= len(parts):  # nothing fits together any more
            return summarizer(instruction, "\n\n".join(reduced))
        parts = reduced


def expand_scope(documents: DataFrame, folders: list[str], paths: list[str], cap: int) -> tuple[list[str], int]:
    """Notes of folders and paths, each once, by path, at most ``cap``; and how many were left out."""
    any_of = F.col("path").isin(paths) if paths else F.lit(False)
    for f in folders:
        any_of = any_of | in_folder(F.col("folder"), f)
    own = documents.filter(any_of)
    total = own.count()
    found = [r.path for r in own.select("path").orderBy("path").limit(cap).collect()]
    return found, total - len(found)
