"""The link graph: resolution, neighbours, broken links, orphans, hubs, paths and neighbourhoods.

``links`` has the columns of model.LINKS, ``documents`` at least path (and folder, title where said).
Nodes are live notes; an edge counts only if both its ends are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import basename_of, folder_of, in_folder, stem_of
from .population import live


def backlinks(links: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """Links into a note (or all notes), with the source's title where it has one, by source and order in it."""
    notes = live(documents)
    own = links if path is None else links.filter(F.col("target_path") == path)
    named = [c for c in ("title",) if c in notes.columns]
    return own.join(notes.select(F.col("path").alias("source_path"), *named), "source_path").orderBy("source_path", "link_ordinal", "target_path")


def outlinks(links: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """Links out of a note (or all), with whether the target is a live note."""
    own = links if path is None else links.filter(F.col("source_path") == path)
    there = live(documents).select(F.col("path").alias("_target")).distinct()
    out = own.join(there, F.col("target_path") == F.col("_target"), "left")
    return out.withColumn("exists", F.col("_target").isNotNull()).drop("_target").orderBy("source_path", "link_ordinal")


def broken_links(links: DataFrame, documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Links whose target is no live note; ``folder`` restricts the source."""
    own = links if folder is None else links.filter(in_folder(folder_of(F.col("source_path")), folder))
    return own.join(live(documents).select(F.col("path").alias("target_path")), "target_path", "left_anti")


def orphans(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Notes with no link out and none in."""
    notes = live(documents)
    return notes.join(links.select(F.col("source_path").alias("path")), "path", "left_anti").join(links.select(F.col("target_path").alias("path")), "path", "left_anti").orderBy("path")


def most_linked(links: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """Live targets by their number of distinct sources; ties by path."""
    pairs = links.select("target_path", "source_path").distinct()
    counted = pairs.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("n_sources"))
    return counted.join(live(documents).select("path"), "path", "left_semi").orderBy(F.desc("n_sources"), "path").limit(limit)


def hub_graph(links: DataFrame, documents: DataFrame, limit: int = 10) -> DataFrame:
    """The top hubs' incoming edges, each (source, target) once."""
    hubs = most_linked(links, documents, limit).select(F.col("path").alias("target_path"))
    return edges(links, documents).join(hubs, "target_path", "left_semi").select("source_path", "target_path")


def edges(links: DataFrame, documents: DataFrame) -> DataFrame:
    """The first link of each (source, target) pair, both live, no loops."""
    notes = live(documents).select("path")
    both = links.join(notes.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(notes.withColumnRenamed("path", "target_path"), "target_path", "left_semi")
    first = F.row_number().over(Window.partitionBy("source_path", "target_path").orderBy("link_ordinal"))
    return both.filter("source_path <> target_path").withColumn("_n", first).filter("_n = 1").drop("_n")


def undirected(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (a, b) for every pair of linked live notes, in both directions, once."""
    notes = live(documents).select("path")
    pairs = links.select(F.col("source_path").alias("a"), F.col("target_path").alias("b")).filter("a <> b")
    pairs = pairs.join(notes.withColumnRenamed("path", "a"), "a", "left_semi").join(notes.withColumnRenamed("path", "b"), "b", "left_semi")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def distances(links: DataFrame, documents: DataFrame, start: str, depth: int, goal: str | None = None) -> DataFrame:
    """Rows (path, distance, previous) of all notes within ``depth`` undirected steps; previous is the least predecessor.

    One join per step; each step's frontier is kept, as plans would else grow with depth. With a goal
    the walk ends with the step that reaches it.
    """
    both = undirected(links, documents).persist()
    frontier = live(documents).filter(F.col("path") == start).select("path", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("previous")).persist()
    seen = frontier
    for step in range(1, depth + 1):
        ahead = frontier.select(F.col("path").alias("a")).join(both, "a").groupBy(F.col("b").alias("path")).agg(F.min("a").alias("previous"))
        frontier = ahead.join(seen.select("path"), "path", "left_anti").select("path", F.lit(step).alias("distance"), "previous").persist()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if goal is not None and not frontier.filter(F.col("path") == goal).isEmpty():
            break
    both.unpersist()
    return seen


def shortest_path(links: DataFrame, documents: DataFrame, start: str, goal: str, max_depth: int = 10) -> list[str] | None:
    """Notes on a shortest undirected path, ends included; None if there is none within 1 to 10 steps."""
    found = distances(links, documents, start, min(max(max_depth, 1), 10), goal)
    path, at = [], goal
    while True:
        row = found.filter(F.col("path") == at).first()
        if row is None:
            return None
        path.append(at)
        if row.distance == 0:
            return path[::-1]
        at = row.previous


def neighbourhood(links: DataFrame, documents: DataFrame, start: str, depth: int = 2, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps, nearest first and at most ``max_nodes``, and the edges among them."""
    nodes = distances(links, documents, start, depth).orderBy("distance", "path").limit(max_nodes).select("path", "distance")
    own = edges(links, documents)
    own = own.join(nodes.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(nodes.select(F.col("path").alias("target_path")), "target_path", "left_semi")
    return nodes, own.select("source_path", "target_path", "link_type")


def graph_view(links: DataFrame, documents: DataFrame, start: str, depth: int = 1, max_nodes: int = 200, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated): a neighbourhood as a picture needs it.

    Nodes: path, folder, distance, group and n_backlinks. Only nodes within ``depth`` - 1 steps have been looked
    at: they count their backlinks, are ``orphan`` without any backlink or link of their own, and give
    edges, one a (source, target) pair; those at ``depth`` are ``note``. ``near`` (path, other, rank) adds an edge of
    type semantic to each node's nearest notes, once a pair, and notes that only such an edge reaches,
    with a null distance, nearest first. At most ``max_nodes`` nodes; ``truncated`` tells whether there were more.
    """
    notes = live(documents)
    folder = F.col("folder") if "folder" in notes.columns else folder_of(F.col("path")).alias("folder")
    reached = distances(links, documents, start, depth).select("path", "distance").orderBy("distance", "path").limit(max_nodes + 1).collect()  # a picture's nodes
    truncated = len(reached) > max_nodes
    spark, schema = documents.sparkSession, "path string, distance int"
    nodes = spark.createDataFrame([(r.path, r.distance) for r in reached[:max_nodes]], schema)
    inner = nodes.filter(F.col("distance") < depth).select("path")
    into = links.join(inner.select(F.col("path").alias("target_path")), "target_path", "left_semi").join(notes.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    out = links.join(inner.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(notes.select(F.col("path").alias("target_path")), "target_path", "left_semi")
    both = into.select("source_path", "target_path", "link_type", "link_ordinal").unionByName(out.select("source_path", "target_path", "link_type", "link_ordinal"))
    shown = nodes.select("path")
    both = both.join(shown.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(shown.withColumnRenamed("path", "target_path"), "target_path", "left_semi")
    found = both.groupBy("source_path", "target_path").agg(F.min_by("link_type", "link_ordinal").alias("link_type"))
    counted = into.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("n_in"))
    leaving = links.select(F.col("source_path").alias("path")).join(inner, "path", "left_semi").distinct().withColumn("leaves", F.lit(True))
    if near is not None:
        own = near.join(shown, "path", "left_semi").filter("path <> other").join(notes.select(F.col("path").alias("other")), "other", "left_semi")
        fresh = own.join(shown.withColumnRenamed("path", "other"), "other", "left_anti").groupBy("other").agg(F.min("rank").alias("rank")).orderBy("rank", "other")
        room = max_nodes - len(reached[:max_nodes])
        more = [r.other for r in fresh.limit(room + 1).collect()]
        truncated |= len(more) > room
        nodes = nodes.unionByName(spark.createDataFrame([(p, None) for p in more[:room]], schema))
        pair = own.join(nodes.select(F.col("path").alias("other")), "other", "left_semi").withColumn("low", F.least("path", "other")).withColumn("high", F.greatest("path", "other"))
        # a pair that each finds near is drawn once, from the nearer finding
        once = pair.groupBy("low", "high").agg(F.min(F.struct("rank", "path", "other")).alias("x"))
        found = found.unionByName(once.select(F.col("x.path").alias("source_path"), F.col("x.other").alias("target_path"), F.lit("semantic").alias("link_type")))
    looked = F.coalesce(F.col("distance") < depth, F.lit(False))
    group = F.when(looked & F.col("n_in").isNull() & F.col("leaves").isNull(), "orphan").otherwise("note")
    placed = nodes.join(notes.select("path", folder), "path", "left").join(counted, "path", "left").join(leaving, "path", "left")
    return placed.select("path", "folder", "distance", group.alias("group"), F.coalesce("n_in", F.lit(0)).alias("n_backlinks")), found, truncated


def path_ends(notes: DataFrame) -> DataFrame:
    """Rows (path, _end): what follows each "/" of a path, which a link may name it by."""
    parts = F.split("path", "/")
    below = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    return notes.select("path", F.explode(below).alias("_end"))


def changed_meaning(links: DataFrame, moved: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (path): sources of links that may mean another note once notes have come or gone.

    ``moved`` (path) holds the notes that came or went, ``names`` (alias) the aliases that did. A link is
    looked at only if its target is one of those paths, one of their ends, or one of those aliases.
    """
    ends = path_ends(moved).select("_end").unionByName(moved.select(F.col("path").alias("_end"))).distinct()
    by_path = links.join(ends, links["target_path"] == ends["_end"], "left_semi").select("source_path")
    lowered = names.select(F.lower("alias").alias("_alias")).distinct()
    by_name = links.filter("link_type = 'wikilink'").join(lowered, F.lower(stem_of(F.col("target_path"))) == F.col("_alias"), "left_semi").select("source_path")
    return by_path.unionByName(by_name).distinct().withColumnRenamed("source_path", "path")


def resolve(links: DataFrame, documents: DataFrame, aliases: DataFrame | None = None, few: bool = False) -> DataFrame:
    """``links`` with target_path set to the note that a vault-wide name means, where there is one.

    A target means a note whose path equals it, or ends with "/" and it. Of several: the exact path,
    then one in the source's own folder, then the shortest, then the first in order. What no path
    matches may be an alias of a note, in any case. Markdown links keep a path that exists, and paths
    with an explicit "./", "../" or "/" in front, as they are. With ``few`` links, paths and aliases that
    none of them names are left out before anything is grouped.
    """
    notes = live(documents).select("path").distinct()
    named = path_ends(notes)
    if few:
        named = named.join(links.select(F.col("target_path").alias("_end")).distinct(), "_end", "left_semi")
        aliases = None if aliases is None else aliases.join(links.select(F.lower(stem_of(F.col("target_path"))).alias("_name")).distinct(), F.lower("alias") == F.col("_name"), "left_semi")
    # every end of a path means one note, so that a file name found in every folder costs no more than another
    ends = named.groupBy("_end").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("_best"))
    fixed = (F.col("link_type") != "wikilink") & F.coalesce(F.col("raw_target").rlike(r"^(/|\./|\.\./)"), F.lit(False))
    home = folder_of(F.col("source_path"))
    beside = F.concat(F.when(home == "", F.lit("")).otherwise(F.concat(home, F.lit("/"))), basename_of(F.col("target_path")))
    beside = F.when(~fixed & beside.endswith(F.concat(F.lit("/"), F.col("target_path"))), beside)
    out = links.withColumn("_beside", beside).withColumn("_wanted", F.when(~fixed, F.col("target_path")))
    out = out.join(notes.select(F.col("path").alias("_exact")), F.col("target_path") == F.col("_exact"), "left")
    out = out.join(notes.select(F.col("path").alias("_own")), F.col("_beside") == F.col("_own"), "left")
    out = out.join(ends, F.col("_wanted") == F.col("_end"), "left")
    out = out.withColumn("_found", F.coalesce("_exact", "_own", "_best.path"))
    if aliases is not None:
        alias = aliases.join(notes, "path", "left_semi").groupBy(F.lower("alias").alias("_alias")).agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("_by_alias"))
        out = out.join(alias, F.lower(stem_of(F.col("target_path"))) == F.col("_alias"), "left")
        out = out.withColumn("_found", F.coalesce("_found", F.when(F.col("link_type") == "wikilink", F.col("_by_alias.path"))))
    return out.withColumn("target_path", F.coalesce("_found", "target_path")).select(*links.columns)


def introduced_unresolved(before: DataFrame, after: DataFrame, documents: DataFrame) -> DataFrame:
    """Targets of broken links that the new links have and the old ones had not."""
    return broken_links(after, documents).select("target_path").distinct().join(before.select("target_path"), "target_path", "left_anti").orderBy("target_path")


def counts(links: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One row: documents, links, broken links, orphans (and chunks)."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(live(documents), "documents").crossJoin(one(links, "links")).crossJoin(one(broken_links(links, documents), "broken_links")).crossJoin(one(orphans(links, documents), "orphans"))
    return out if sections is None else out.crossJoin(one(sections, "chunks"))


def context(path: str, links: DataFrame, documents: DataFrame, tags: DataFrame, peers: int = 20) -> dict[str, DataFrame]:
    """What is known around a note: links in and out, peers below its folder, its tags."""
    folder = path.rpartition("/")[0]
    near = live(documents).filter(in_folder(F.col("folder"), folder) & (F.col("path") != path)).orderBy("path").limit(peers)
    return {
        "backlinks": backlinks(links, documents, path),
        "outlinks": outlinks(links, documents, path),
        "peers": near.select("path"),
        "tags": tags.filter(F.col("path") == path).select("tag_key", "tag_value").orderBy("tag_key", "tag_value"),
    }
