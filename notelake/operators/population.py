"""Exact queries: the population of notes that a filter selects, its pages, counts and groups.

Every function takes and returns DataFrames. ``documents`` has the columns of model.DOCUMENTS
(of which each function reads few), ``tags`` those of model.TAGS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex, in_folder
from ..model import DocumentFilter, InvalidRequest, check_page


def live(documents: DataFrame) -> DataFrame:
    """Notes without the rows kept for skipped files."""
    return documents.filter("skip_category is null") if "skip_category" in documents.columns else documents


def population(documents: DataFrame, tags: DataFrame, where: DocumentFilter, hits: DataFrame | None = None, okf: DataFrame | None = None) -> DataFrame:
    """Distinct live notes that pass every restriction; with ``hits`` (path, score) also their best score.

    ``okf`` (path, type, status, stale, trust_tier) is read only where a restriction names one of its columns.
    """
    out = live(documents)
    if where.path is not None:
        out = out.filter(F.col("path") == where.path)
    out = out.filter(in_folder(F.col("folder"), where.folder))
    if where.path_glob is not None:
        out = out.filter(F.col("path").rlike(glob_regex(where.path_glob)))
    if where.path_prefix is not None:
        out = out.filter(F.col("path_folded").startswith(where.path_prefix.casefold()))
    if where.path_contains is not None:
        out = out.filter(F.col("path_folded").contains(where.path_contains.casefold()))
    if where.modified_from is not None:
        out = out.filter(F.col("modified_at") >= where.modified_from)
    if where.modified_to is not None:
        out = out.filter(F.col("modified_at") < where.modified_to)
    for key, value in where.tags:
        own = tags.filter((F.col("tag_key") == key) & (F.col("tag_value") == value)).select("path")
        out = out.join(own, "path", "left_semi")
    if where.derived:
        if okf is None:
            raise InvalidRequest("the table of maintained metadata is needed")
        own = okf
        for key, value in where.derived:
            own = own.filter(F.col(key).cast("string") == value)
        out = out.join(own.select("path"), "path", "left_semi")
    if hits is not None:
        out = out.join(hits.groupBy("path").agg(F.max("score").alias("score")), "path")
    return out


def count(selected: DataFrame) -> DataFrame:
    """One row with the size of a population; no content is read."""
    return selected.agg(F.count(F.lit(1)).alias("total"))


def page(selected: DataFrame, limit: int = 50, offset: int = 0, order: str = "auto") -> DataFrame:
    """Rows offset .. offset+limit-1 by score (or age) and path, by path, or by folded path."""
    limit, offset = check_page(limit, offset)
    lead = F.desc("score") if "score" in selected.columns else F.desc("modified_at")
    orders = {"auto": (lead, F.asc("path")), "path": (F.asc("path"),), "folded_path": (F.asc("path_folded"), F.asc("path"))}
    if order not in orders:
        raise InvalidRequest(f"unknown order {order!r}")
    return selected.orderBy(*orders[order]).offset(offset).limit(limit)


def group_keys(selected: DataFrame, tags: DataFrame, by: str, tag_key: str | None = None) -> DataFrame:
    """Rows (path, key) of one axis: folder, month (UTC, floored) or the values of a tag, null where it is missing."""
    if by == "folder":
        return selected.select("path", F.col("folder").alias("key"))
    if by == "month":
        return selected.select("path", F.date_format(F.timestamp_seconds(F.floor("modified_at")), "yyyy-MM").alias("key"))
    if by != "tag" or not tag_key:
        raise InvalidRequest("group by folder, month, or tag with a key")
    own = tags.filter(F.col("tag_key") == tag_key).select("path", F.col("tag_value").alias("key"))
    return selected.select("path").join(own, "path", "left").dropDuplicates(["path", "key"])


def aggregate(keys: DataFrame, limit: int = 100) -> DataFrame:
    """Top buckets (key, n, truncated) by count, folded key and key, null first."""
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    folded = F.lower(F.upper("key"))  # upper case first, so that letters like sharp s fold too
    order = (F.desc("n"), F.asc_nulls_first(folded), F.asc_nulls_first("key"))
    top = buckets.orderBy(*order).limit(limit + 1)
    at = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows at most
    numbered = top.withColumn("_at", at)
    return numbered.withColumn("truncated", F.max("_at").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("_at") <= limit).drop("_at")


def missing(keys: DataFrame) -> DataFrame:
    """How many notes have no key."""
    return keys.agg(F.sum(F.col("key").isNull().cast("long")).alias("missing"))


def distinct_folders(documents: DataFrame) -> DataFrame:
    return live(documents).select("folder").distinct().orderBy("folder")


def distinct_values(tags: DataFrame, tag_key: str, indexed_keys: frozenset[str] | None = None) -> DataFrame:
    """Values of an indexed field; a key that isn't one of ``indexed_keys`` is refused."""
    if indexed_keys is not None and tag_key not in indexed_keys:
        raise InvalidRequest(f"{tag_key!r} isn't an indexed field; there are {sorted(indexed_keys)}")
    return tags.filter(F.col("tag_key") == tag_key).select("tag_value").distinct().orderBy("tag_value")


def frontmatter_values(documents: DataFrame, key: str) -> DataFrame:
    """Rows (path, value) of any front-matter key of live notes, as JSON text (strings plain), null where it is missing."""
    name = key.replace("'", "\\'")
    return live(documents).select("path", F.get_json_object("frontmatter_json", f"$['{name}']").alias("value"))


def recent(documents: DataFrame, limit: int = 20, folder: str | None = None) -> DataFrame:
    """Newest notes first; ties by path."""
    return live(documents).filter(in_folder(F.col("folder"), folder)).orderBy(F.desc("modified_at"), "path").limit(limit)


def listing(documents: DataFrame, pattern: str | None = None, folder: str | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """Notes by path, with an optional fnmatch pattern, folder, and equality on any frontmatter key."""
    from ..functions.patterns import fnmatch_regex

    out = live(documents).filter(in_folder(F.col("folder"), folder))
    if pattern is not None:
        out = out.filter(F.col("path").rlike(fnmatch_regex(pattern)))
    for key, value in (fields or {}).items():
        out = out.filter(F.coalesce(F.array_contains(F.col("frontmatter")[key], value), F.lit(False)))
    return out.orderBy("path")


def subtree(documents: DataFrame, folder: str, max_notes: int) -> DataFrame:
    """Notes of a subtree by path, at most ``max_notes``, and whether there are more."""
    top = live(documents).filter(in_folder(F.col("folder"), folder)).orderBy("path").limit(max_notes + 1)
    at = F.row_number().over(Window.orderBy("path"))  # over max_notes + 1 rows at most
    return top.withColumn("_at", at).withColumn("truncated", F.max("_at").over(Window.partitionBy(F.lit(1))) > max_notes).filter(F.col("_at") <= max_notes).drop("_at")


def lookup(documents: DataFrame, path: str) -> DataFrame:
    """The live note of a path; no row if there is none."""
    return live(documents).filter(F.col("path") == path).limit(1)


def skipped(documents: DataFrame) -> DataFrame:
    return documents.filter("skip_category is not null").select("path", "skip_category", "skip_detail").orderBy("path")


def chunk_counts(documents: DataFrame, paths: list[str] | None = None) -> DataFrame:
    out = live(documents).select("path", "chunk_count")
    return out if paths is None else out.filter(F.col("path").isin(paths))


def chunks(documents: DataFrame, sections: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All chunks of live notes, or of the notes that ``paths`` (path) names, by path and order in the note."""
    own = sections.join(live(documents).select("path"), "path", "left_semi")
    return (own if paths is None else own.join(paths.select("path"), "path", "left_semi")).orderBy("path", "ordinal")


def chunk_page(documents: DataFrame, sections: DataFrame, after: tuple[str, int] | None = None, limit: int = 1000) -> DataFrame:
    """The next ``limit`` chunks behind a place (path, ordinal); the last row's place asks for the next page."""
    own = sections.join(live(documents).select("path"), "path", "left_semi")
    if after is not None:
        own = own.filter((F.col("path") > after[0]) | ((F.col("path") == after[0]) & (F.col("ordinal") > after[1])))
    return own.orderBy("path", "ordinal").limit(limit)


def with_attachments(documents: DataFrame, attachments: DataFrame) -> DataFrame:
    """Notes and attachments in one listing (path, folder, kind, title, mime) by path."""
    title = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    notes = live(documents).select("path", "folder", F.lit("note").alias("kind"), title.alias("title"), F.lit("text/markdown").alias("mime"))
    files = attachments.select("path", "folder", F.lit("attachment").alias("kind"), F.lit(None).cast("string").alias("title"), "mime")
    return notes.unionByName(files).orderBy("path")


def histogram(okf: DataFrame, column: str) -> DataFrame:
    """Notes by the value of a derived column, those without any metadata left out."""
    return okf.filter("status is not null").groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def with_sections(selected: DataFrame, sections: DataFrame, per_note: int, scores: DataFrame | None = None) -> DataFrame:
    """Each note of a page with its best ``per_note`` sections as an array, best first.

    ``scores`` (path, ordinal, score) ranks them; without it they come in document order.
    """
    rows = sections.join(selected.select("path"), "path", "left_semi")
    if scores is not None:
        rows = rows.join(scores, ["path", "ordinal"])
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "ordinal"))
    best = rows.withColumn("rank", rank).filter(F.col("rank") <= per_note)
    nested = best.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rank", "ordinal", "heading", "content", "start_line", "score"))).alias("sections"))
    return selected.join(nested, "path", "left")


def path_search(documents: DataFrame, query: str, fuzzy: bool = True, limit: int = 50, candidates: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Paths by tier: 0 exact, 1 prefix, 2 substring (both folded), 3 every query token within one edit of a path token.

    One scan gives the best tier of each path. With an ``index`` (see ``name_index``) tier 3 is a join with
    it instead, which compares only tokens that can be near. ``candidates`` caps the paths looked at for
    tier 3, by path; without it all are.
    """
    folded = query.casefold()
    notes = live(documents).select("path", "path_folded")
    tokens = path_tokens(F.lit(query))
    own = path_tokens(F.col("path"))
    near = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.exists(own, lambda u: F.levenshtein(t, u, 1) >= 0))
    tier = F.when(F.col("path") == query, 0).when(F.col("path_folded").startswith(folded), 1).when(F.col("path_folded").contains(folded), 2)
    plain = notes.withColumn("tier", tier).filter("tier is not null")
    if not fuzzy:
        found = plain
    elif candidates is None and index is None:
        found = notes.withColumn("tier", tier.when(near, 3)).filter("tier is not null")
    else:
        if index is not None:
            looked = notes.join(near_names(index, query), "path", "left_semi")
        else:
            looked = notes.orderBy("path").limit(candidates).filter(near)
        found = plain.unionByName(looked.withColumn("tier", F.lit(3))).groupBy("path", "path_folded").agg(F.min("tier").alias("tier"))
    return found.orderBy("tier", "path_folded", "path").limit(limit).select("path", "tier")


def _shortened(token):
    """A token and what is left of it without each one of its characters; tokens one edit apart share one of these."""
    without = F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.concat(token.substr(F.lit(1), k - 1), token.substr(k + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), without))


def name_index(documents: DataFrame) -> DataFrame:
    """Rows (path, token, variant): the tokens of live notes' paths under each of their shortened forms."""
    each = live(documents).select("path", F.explode(F.array_distinct(path_tokens(F.col("path")))).alias("token"))
    return each.select("path", "token", F.explode(_shortened(F.col("token"))).alias("variant"))


def near_names(index: DataFrame, query: str) -> DataFrame:
    """Rows (path) that have a token within one edit of every token of the query; none for a query without tokens.

    An equi-join over shortened forms finds the tokens that can be near, and the distance confirms them.
    """
    asked = index.sparkSession.range(1).select(F.posexplode(F.array_distinct(path_tokens(F.lit(query)))).alias("at", "asked"))
    wanted = asked.select("at", "asked", F.explode(_shortened(F.col("asked"))).alias("variant"))
    met = index.join(F.broadcast(wanted), "variant").filter(F.levenshtein("asked", "token", 1) >= 0)  # a query's tokens: some dozens of rows
    n = F.size(F.array_distinct(path_tokens(F.lit(query))))
    return met.groupBy("path").agg(F.count_distinct("at").alias("n")).filter(F.col("n") == n).select("path")


def path_tokens(path):
    """Lower-cased ASCII tokens of 3 to 64 characters between slashes, white space, ``_``, ``-`` and ``.``."""
    return F.filter(F.split(F.lower(path), r"[/\s_.\-]+"), lambda t: t.rlike(r"^[a-z0-9]{3,64}\z"))
