"""More registered queries: vaults of varied Markdown, ranked search from end to end, and upkeep.

The notes are those of ``queries``; the Markdown around them varies by doc_id, and the SQL derives
from doc_id what must come out.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown
from .functions.fts_query import parse_lenient
from .functions.text import find_normal
from .model import DOCUMENTS, DocumentFilter, parse_instant
from .operators import fulltext, graph, history, population, ranking, vector
from .queries import _CHUNKS, _HITS, _hits, _index, _plain, _query_vector, _r, _score_sql, _t, _term_sql, links, nodes, notes, query, sections, tags, vectors
from .sources import vault as source

X = "x AS (SELECT 1) "

# --- exact queries --------------------------------------------------------------------------


@query(X + "SELECT path, content_chars FROM notes WHERE path = 'en/src1/' || (SELECT min(doc_id) FROM documents WHERE lang = 'en' AND source = 'src1') || '.md'")
def exact_path(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    first = own.filter("lang = 'en' and source = 'src1'").agg(F.min("doc_id")).first()[0]
    return population.population(own, tags(spark, sf), DocumentFilter(path=f"en/src1/{first}.md")).select("path", "content_chars")


@query(X + "SELECT path FROM notes WHERE starts_with(folder, 'en/') AND path LIKE '%1%' AND modified_at >= 1600000000 AND path IN (SELECT path FROM tags WHERE tag_key = 'quality' AND tag_value = '1')")
def exact_combined(spark: SparkSession, sf: str) -> DataFrame:
    where = DocumentFilter(folder="en", path_contains="1", modified_from=parse_instant("2020-09-13T12:26:40Z"), tags=(("quality", "1"),))
    return population.population(notes(spark, sf), tags(spark, sf), where).select("path")


def _okf(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 5 == 0, "deprecated").otherwise("stable")
    return notes(spark, sf).select("path", status.alias("status"), F.lit("note").alias("type"), (F.col("doc_id") % 7 == 0).alias("stale"), F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("unverified").alias("trust_tier"))


@query(X + "SELECT path FROM notes WHERE doc_id % 5 = 0 AND doc_id % 7 = 0 AND doc_id % 3 = 0")
def exact_okf_filters(spark: SparkSession, sf: str) -> DataFrame:
    where = DocumentFilter(status="deprecated", stale=True, trust_tier="verified")
    return population.population(notes(spark, sf), tags(spark, sf), where, okf=_okf(spark, sf)).select("path")


@query(X + "SELECT CASE WHEN doc_id % 5 = 0 THEN 'deprecated' ELSE 'stable' END AS value, count(*) AS n FROM notes GROUP BY 1 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'unverified' END, count(*) FROM notes GROUP BY 1")
def okf_histograms(spark: SparkSession, sf: str) -> DataFrame:
    own = _okf(spark, sf)
    return population.histogram(own, "status").unionByName(population.histogram(own, "trust_tier"))


@query(X + "SELECT path FROM notes WHERE lang = 'fr' AND source = 'src2'")
def listing_by_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf).withColumn("frontmatter", F.create_map(F.lit("lang"), F.array("lang"), F.lit("origin"), F.array("source", F.lit("other"))))
    return population.listing(own, fields={"lang": "fr", "origin": "src2"}).select("path")


@query(X + "SELECT path, modified_at FROM notes WHERE doc_id % 4 <> 1")
def live_notes(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf).withColumn("skip_category", F.when(F.col("doc_id") % 4 == 1, "parse_error"))
    return population.listing(own).select("path", "modified_at")


@query(X + "SELECT path, 'decode_error' AS skip_category FROM notes WHERE doc_id % 4 = 1")
def skipped_report(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf).withColumn("skip_category", F.when(F.col("doc_id") % 4 == 1, "decode_error")).withColumn("skip_detail", F.lit(None).cast("string"))
    return population.skipped(own).select("path", "skip_category")


@query(X + "SELECT path FROM notes WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    path = own.filter("doc_id = 17").first()
    return population.lookup(own, path.path if path else "").select("path")


@query(X + "SELECT path, (SELECT count(*) FROM (SELECT path, unnest(string_split(text, chr(10))) AS c FROM notes) s WHERE s.path = n.path AND c <> '') AS n FROM notes n")
def chunk_counts_per_path(spark: SparkSession, sf: str) -> DataFrame:
    counted = sections(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    own = notes(spark, sf).join(counted, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return population.chunk_counts(own).select("path", F.col("chunk_count").cast("long").alias("n"))


@query("s AS (SELECT path FROM notes WHERE folder = 'en' OR starts_with(folder, 'en/') ORDER BY path LIMIT 40) SELECT path, (SELECT count(*) FROM notes WHERE starts_with(folder, 'en/')) > 40 AS truncated FROM s")
def subtree_cap(spark: SparkSession, sf: str) -> DataFrame:
    return population.subtree(notes(spark, sf), "en", 40).select("path", "truncated")


_LINES = "c AS (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS ordinal FROM notes) "


@query(_LINES + "SELECT path, ordinal, content FROM c WHERE content <> '' AND doc_id % 10 = 3")
def chunk_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the notes that a table names."""
    own = notes(spark, sf)
    return population.chunks(own, sections(spark, sf), own.filter("doc_id % 10 = 3").select("path")).select("path", "ordinal", "content")


@query(_LINES + "SELECT path, ordinal FROM c WHERE content <> '' AND (path, ordinal) > ('de/src5/', 0) ORDER BY path, ordinal LIMIT 300")
def chunk_page_after(spark: SparkSession, sf: str) -> DataFrame:
    return population.chunk_page(notes(spark, sf), sections(spark, sf), ("de/src5/", 0), 300).select("path", "ordinal")


@query(X + "SELECT path, content_hash, modified_at FROM notes")
def state_scan(spark: SparkSession, sf: str) -> DataFrame:
    return population.live(notes(spark, sf)).select("path", "content_hash", "modified_at")


@query(X + "SELECT path, folder, 'note' AS kind, 'text/markdown' AS mime FROM notes UNION ALL SELECT 'files/' || page_id || '.html', 'files', 'attachment', 'text/html' FROM pages")
def notes_and_attachments(spark: SparkSession, sf: str) -> DataFrame:
    files = _t(spark, sf, "pages").select(F.concat(F.lit("files/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("files").alias("folder"), F.lit("text/html").alias("mime"))
    return population.with_attachments(notes(spark, sf), files).select("path", "folder", "kind", "mime")


# --- keyword search -------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str, text: str, scope: tuple[str, ...], **more) -> DataFrame:
    node = parse_lenient(text, ("content", "title"), scope)
    postings, lengths = _index(spark, sf, fulltext.Asked.by(node, _plain))
    return fulltext.bm25(postings, lengths, node, tokenize=_plain, **more).select("path", "ordinal", _r("score"))


@query(_CHUNKS + _score_sql([("len(list_filter(body, lambda t: t = 'en'))", "0")], "b0 + n0 > 0"))
def bm25_body_scope(spark: SparkSession, sf: str) -> DataFrame:
    """A word that many paths hold, looked for in the text alone."""
    return _scored(spark, sf, "en", ("content",))


@query(_CHUNKS + _score_sql([("0", "len(list_filter(name, lambda t: t = 'src1'))")], "b0 + n0 > 0"))
def bm25_metadata_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "src1", ("title",))


@query(_CHUNKS + _score_sql([_term_sql("the"), _term_sql("and")], "b0 + n0 > 0 AND b1 + n1 > 0"))
def bm25_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """A query that can't be read as it stands is read as the words in it."""
    return _scored(spark, sf, "the ( and", ("content", "title"))


@query(_CHUNKS + _score_sql([_term_sql("the")], "b0 + n0 > 0"))
def bm25_unknown_weight(spark: SparkSession, sf: str) -> DataFrame:
    """A weight for a column that isn't there changes nothing, and is warned of."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _scored(spark, sf, "the", ("content", "title"), weights={"nothing": 9.0})


@query(_HITS + X + """SELECT path, ordinal, score, row_number() OVER (ORDER BY score DESC, path, ordinal)::INT AS rank FROM k ORDER BY k.score DESC, path, ordinal LIMIT 60""")
def keyword_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded pool of candidates of a keyword channel."""
    return ranking.ranked(_hits(spark, sf), "keyword", ranking.candidate_pool(10, 2)).select("path", "ordinal", "score", F.col("rank").cast("int").alias("rank"))


_RANKED = _HITS + """a AS (SELECT path, ordinal, score * CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1 END * CASE WHEN doc_id % 7 = 0 THEN 0.75 ELSE 1 END / (1 + 0.25 * ln(chunk_count)) * CASE WHEN starts_with(k.folder, 'fr/') THEN 2.0 ELSE 1 END AS score FROM k JOIN notes USING (path)),
o AS (SELECT path, ordinal, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) AS note_rank FROM a),
f AS (SELECT path, max(score) AS best FROM o GROUP BY path ORDER BY best DESC, path LIMIT 20)
"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits through the whole chain: metadata, length, folder, collapse."""
    rows = ranking.okf_downweight(_hits(spark, sf).join(_okf(spark, sf), "path"))
    return ranking.collapse(ranking.folder_boost(ranking.length_downweight(rows), {"fr": 2.0}), 20, 2)


@query(_RANKED + "SELECT path, ordinal, round(score, 5) AS score, note_rank::INT AS note_rank FROM o JOIN f USING (path) WHERE note_rank <= 2")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("path", "ordinal", F.round("score", 5).alias("score"), "note_rank")


@query(_RANKED + "SELECT path, round(best, 5) AS score, list(ordinal ORDER BY score DESC, ordinal)::VARCHAR AS sections FROM o JOIN f USING (path) WHERE note_rank <= 2 GROUP BY path, best")
def assembled_search(spark: SparkSession, sf: str) -> DataFrame:
    """One row per note of the result, its best sections in order."""
    named = F.concat(F.lit("["), F.array_join(F.transform("sections", lambda s: s["ordinal"].cast("string")), ", "), F.lit("]"))
    return ranking.assemble(_ranked(spark, sf)).select("path", F.round("score", 5).alias("score"), named.alias("sections"))


@query(_HITS + X + "SELECT path, ordinal, round(score * CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1 END * CASE WHEN doc_id % 7 = 0 THEN 0.75 ELSE 1 END, 9) AS score FROM k JOIN notes USING (path)")
def rank_okf_downweight(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.okf_downweight(_hits(spark, sf).join(_okf(spark, sf), "path")).select("path", "ordinal", F.round("score", 9).alias("score"))


# --- vectors --------------------------------------------------------------------------------


@query(X + "SELECT path, ordinal, round(v[1]::FLOAT::DOUBLE, 5) AS first, round(sqrt(list_dot_product(v, v)), 5) AS size FROM vectors")
def vector_normalised(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).cast("string").alias("path"), (F.col("vec_id") % 5).cast("int").alias("ordinal"), "embedding")
    made = vector.normalise(own, 64)
    return made.select("path", "ordinal", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(vector.norm(F.col("embedding")), 5).alias("size"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("path", F.lit(0).alias("ordinal"), "folder", "doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("embedding_text"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all notes but one in seven, and of notes that are gone."""
    own = _inputs(spark, sf).filter("doc_id % 7 <> 2").withColumn("embedding", F.array(F.col("doc_id").cast("float")))
    gone = _t(spark, sf, "region").select(F.concat(F.lit("gone/"), F.col("r_regionkey").cast("string")).alias("path"), F.lit(0).alias("ordinal"), F.lit("gone").alias("folder"), F.lit(-1).cast("long").alias("doc_id"), F.lit("gone").alias("embedding_text"), F.array(F.lit(0).cast("float")).alias("embedding"))
    return own.unionByName(gone)


@query(X + """SELECT path, CASE WHEN doc_id % 11 = 4 OR doc_id % 7 = 2 THEN 'missing' ELSE 'reused' END AS state FROM notes UNION ALL SELECT 'gone/' || r_regionkey, 'unbacked' FROM region""")
def vector_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose vectors can stay, chunks to embed, and vectors without a note; one note in eleven was edited."""
    edited = F.when(F.col("doc_id") % 11 == 4, F.concat("embedding_text", F.lit(" new"))).otherwise(F.col("embedding_text"))
    current = _inputs(spark, sf).withColumn("embedding_text", edited).drop("doc_id")
    parts = vector.reconcile(current, _stored(spark, sf).drop("doc_id"))
    named = [p.select("path", F.lit(n).alias("state")) for p, n in zip(parts, ("reused", "missing", "unbacked"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(X + "SELECT path, doc_id::DOUBLE AS value FROM notes WHERE doc_id % 7 <> 2")
def vector_import(spark: SparkSession, sf: str) -> DataFrame:
    """A donor store's vectors for the chunks whose input it has embedded."""
    found = vector.import_matching(_inputs(spark, sf).drop("doc_id"), _stored(spark, sf).drop("doc_id"), True)
    return found.select("path", F.col("embedding")[0].cast("double").alias("value"))


@query("""q AS (SELECT v AS q FROM vectors WHERE path = '1' AND ordinal = 2), s AS (SELECT path, ordinal, list_dot_product(v, q) AS score FROM vectors, q ORDER BY score DESC, path, ordinal LIMIT 50)
SELECT path, ordinal, round(score, 6) AS score, 5 AS chunk_count FROM s WHERE path::BIGINT % 2 = 0""")
def vector_attached(spark: SparkSession, sf: str) -> DataFrame:
    """Semantic rows whose note is indexed; here those with an even number."""
    rows = vector.semantic(vectors(spark, sf), _query_vector(spark, sf), 50)
    own = vectors(spark, sf).groupBy("path").agg(F.lit(5).alias("chunk_count")).filter(F.col("path").cast("long") % 2 == 0)
    return vector.attach_live(rows, own).select("path", "ordinal", _r("score"), "chunk_count")


# --- graph ----------------------------------------------------------------------------------


@query("""c AS (SELECT min(c_custkey) AS k FROM customer), p AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = (SELECT k FROM c))
SELECT 0 AS step, 'customer/' || c_custkey AS path FROM p UNION ALL SELECT 1, 'nation/' || c_nationkey FROM p UNION ALL SELECT 2, 'region/' || n_regionkey FROM p""")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    first = _t(spark, sf, "customer").orderBy("c_custkey").first()
    region = _t(spark, sf, "nation").filter(F.col("n_nationkey") == first.c_nationkey).first().n_regionkey
    found = graph.shortest_path(links(spark, sf), nodes(spark, sf), f"customer/{first.c_custkey}", f"region/{region}")
    return spark.createDataFrame(list(enumerate(found)), "step int, path string")


@query(X + "SELECT DISTINCT 'nation/' || (c_nationkey + 20) AS target_path FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation) AND c_nationkey <> 7")
def introduced_links(spark: SparkSession, sf: str) -> DataFrame:
    """Broken targets that an edit brought in; one of them was there before."""
    new = _t(spark, sf, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("source_path"), F.concat(F.lit("nation/"), (F.col("c_nationkey") + 20).cast("string")).alias("target_path"))
    return graph.introduced_unresolved(new.filter("target_path = 'nation/27'"), new, nodes(spark, sf))


@query("""w AS (SELECT path AS source_path, 'Topic ' || (doc_id + 2) AS name FROM notes), a AS (SELECT path, 'TOPIC ' || doc_id AS alias FROM notes)
SELECT w.source_path, coalesce(a.path, name || '.md') AS target_path FROM w LEFT JOIN a ON lower(alias) = lower(name)""")
def link_resolution_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Wikilinks that only an alias resolves, in any case."""
    own = notes(spark, sf)
    aliases = own.select("path", F.concat(F.lit("TOPIC "), F.col("doc_id").cast("string")).alias("alias"))
    wiki = own.select(F.col("path").alias("source_path"), F.lit(0).alias("link_ordinal"), F.concat(F.lit("Topic "), (F.col("doc_id") + 2).cast("string"), F.lit(".md")).alias("target_path"), F.lit("wikilink").alias("link_type"), F.lit(None).cast("string").alias("raw_target"))
    return graph.resolve(wiki, own, aliases).select("source_path", "target_path")


@query("""p AS (SELECT path FROM nodes WHERE starts_with(path, 'nation/') AND path <> 'nation/3' ORDER BY path LIMIT 20)
SELECT 'backlink' AS kind, source_path AS value FROM links WHERE target_path = 'nation/3' UNION ALL SELECT 'outlink', target_path FROM links WHERE source_path = 'nation/3' UNION ALL SELECT 'peer', path FROM p""")
def context_dossier(spark: SparkSession, sf: str) -> DataFrame:
    own = nodes(spark, sf).withColumn("folder", F.regexp_extract("path", "^([^/]*)/", 1))
    found = graph.context("nation/3", links(spark, sf), own, spark.createDataFrame([], "path string, tag_key string, tag_value string"))
    named = [found["backlinks"].select(F.lit("backlink").alias("kind"), F.col("source_path").alias("value")), found["outlinks"].select(F.lit("outlink"), "target_path"), found["peers"].select(F.lit("peer"), "path")]
    return named[0].union(named[1]).union(named[2])


# --- varied Markdown ------------------------------------------------------------------------


def _written(spark: SparkSession, sf: str, table: str, body: Column, front: Column | None = None, **options) -> DataFrame:
    """A table of notes with the given Markdown, parsed for it alone."""
    text = body if front is None else F.concat(F.lit("---\n"), front, F.lit("\n---\n"), body)
    files = notes(spark, sf).select("path", F.col("modified_at").alias("mtime"), text.cast("binary").alias("content"))
    columns = tuple(DOCUMENTS.fieldNames()) if table == "documents" else (table,)
    return source.tables(source.parse(files, source.ParseOptions(**options), columns))[table]


def _case(n: int, *cases: str) -> Column:
    """The text of doc_id modulo ``n``, with {i} for the doc_id and {j} for the next."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(cases):
        filled = F.replace(F.replace(F.lit(text), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{j}"), (F.col("doc_id") + 1).cast("string"))
        out = F.when(F.col("doc_id") % n == k, filled).otherwise(out)
    return out


_LINK_CASES = (
    "See [next]({j}.md#top) and ![img [in](in{i}.md) x](p.png).\n",
    "[full][x] [collapsed][] [x] [q][undef] [text *y*][ X ]\n\n[x]: ref{i}.md\n[collapsed]: col.md\n",
    "[[W{i}|alias]] ![[pic.png]] `[no](x.md)` [[Home#part]]\n",
    "[a [b](y{i}.md) c](z.md) and [bbb](b.md) then [rr][x] and [[W]]\n\n[x]: c.md\n",
    "[ext](https://e.x/a.md) [anchor](#a) [pdf](x.pdf) [enc](my%20note.md) [sp](my note.md)\n\n# [h](h{i}.md)\n[open\n\nnot](n.md)\n",
    "```\n[code](c.md)\n```\n- [up](../u{i}.md)\n- [root](/r{i}.md \"title\") \\[esc](e.md) [p](a(b){i}.md)\n",
)


@query("""e AS (
SELECT path, folder, 0 AS o, folder || '/' || (doc_id + 1) || '.md' AS t, 'markdown' AS k, 'next' AS x, 'top' AS f FROM notes WHERE doc_id % 6 = 0
UNION ALL SELECT path, folder, 1, folder || '/in' || doc_id || '.md', 'markdown', 'in', NULL FROM notes WHERE doc_id % 6 = 0
UNION ALL SELECT path, folder, 0, folder || '/ref' || doc_id || '.md', 'reference', 'full', NULL FROM notes WHERE doc_id % 6 = 1
UNION ALL SELECT path, folder, 1, folder || '/col.md', 'reference', 'collapsed', NULL FROM notes WHERE doc_id % 6 = 1
UNION ALL SELECT path, folder, 2, folder || '/ref' || doc_id || '.md', 'reference', 'x', NULL FROM notes WHERE doc_id % 6 = 1
UNION ALL SELECT path, folder, 3, folder || '/ref' || doc_id || '.md', 'reference', 'text *y*', NULL FROM notes WHERE doc_id % 6 = 1
UNION ALL SELECT path, folder, 0, 'W' || doc_id || '.md', 'wikilink', 'alias', NULL FROM notes WHERE doc_id % 6 = 2
UNION ALL SELECT path, folder, 1, 'Home.md', 'wikilink', 'Home#part', 'part' FROM notes WHERE doc_id % 6 = 2
UNION ALL SELECT path, folder, 0, folder || '/y' || doc_id || '.md', 'markdown', 'b', NULL FROM notes WHERE doc_id % 6 = 3
UNION ALL SELECT path, folder, 1, folder || '/b.md', 'markdown', 'bbb', NULL FROM notes WHERE doc_id % 6 = 3
UNION ALL SELECT path, folder, 2, folder || '/c.md', 'reference', 'rr', NULL FROM notes WHERE doc_id % 6 = 3
UNION ALL SELECT path, folder, 3, 'W.md', 'wikilink', 'W', NULL FROM notes WHERE doc_id % 6 = 3
UNION ALL SELECT path, folder, 0, folder || '/my note.md', 'markdown', 'enc', NULL FROM notes WHERE doc_id % 6 = 4
UNION ALL SELECT path, folder, 1, folder || '/my note.md', 'markdown', 'sp', NULL FROM notes WHERE doc_id % 6 = 4
UNION ALL SELECT path, folder, 2, folder || '/h' || doc_id || '.md', 'markdown', 'h', NULL FROM notes WHERE doc_id % 6 = 4
UNION ALL SELECT path, folder, 0, lang || '/u' || doc_id || '.md', 'markdown', 'up', NULL FROM notes WHERE doc_id % 6 = 5
UNION ALL SELECT path, folder, 1, 'r' || doc_id || '.md', 'markdown', 'root', NULL FROM notes WHERE doc_id % 6 = 5
UNION ALL SELECT path, folder, 2, folder || '/a(b)' || doc_id || '.md', 'markdown', 'p', NULL FROM notes WHERE doc_id % 6 = 5)
SELECT path AS source_path, o AS link_ordinal, t AS target_path, k AS link_type, x AS link_text, f AS fragment FROM e""")
def parse_links_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of link, nesting, escapes, code and text that is none, by doc_id."""
    return _written(spark, sf, "links", _case(6, *_LINK_CASES)).select("source_path", "link_ordinal", "target_path", "link_type", "link_text", "fragment")


@query("""e AS (
SELECT path, '' AS label, 'declared' AS status, 0 AS n, 'R' || doc_id AS r FROM notes WHERE doc_id % 4 = 0
UNION ALL SELECT path, 's', 'matched', 2, 'R' || doc_id FROM notes WHERE doc_id % 4 = 0 UNION ALL SELECT path, 'zz', 'unmatched', 1, '' FROM notes WHERE doc_id % 4 = 0
UNION ALL SELECT path, '', 'declared', 0, 'A' FROM notes WHERE doc_id % 4 = 1 UNION ALL SELECT path, '', 'declared', 0, 'B' || doc_id FROM notes WHERE doc_id % 4 = 1
UNION ALL SELECT path, 'd', 'ambiguous', 1, '' FROM notes WHERE doc_id % 4 = 1 UNION ALL SELECT path, 'n', 'invalid_resource', 1, '' FROM notes WHERE doc_id % 4 = 1)
SELECT path, label, status, n AS occurrences, r AS resource FROM e""")
def parse_citations_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with equal, missing and blank resources, repeated ids, notes without marks or sources."""
    front = _case(
        4,
        "sources: [{id: s, resource: R{i}}, {id: t, resource: R{i}}, {id: u}, 7]",
        "sources: [{id: d, resource: A}, {id: d, resource: B{i}}, {id: n, resource: ' '}]",
        "title: T{i}",
        "sources: [{id: s, resource: R}]",
    )
    body = _case(4, "One[^s] two[^s], `[^s]` three[^zz].\n\n[^s]: note\n", "One[^d] two[^n].\n", "One[^s].\n", "None.\n")
    return _written(spark, sf, "citations", body, front).select("path", "label", "status", "occurrences", "resource")


@query(X + "SELECT path, doc_id % 4 = 0 AS cites FROM notes WHERE doc_id % 4 = 0 OR doc_id % 4 = 3")
def find_citing(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that declare one resource, and whether a label of theirs is matched to it."""
    front = _case(4, "sources: [{id: s, resource: R}]", "sources: [{id: s, resource: S}]", "title: T", "sources: [{id: t, resource: R}]")
    c = _written(spark, sf, "citations", F.lit("One[^s].\n"), front)
    declared = c.filter("status = 'declared' and resource = 'R'").select("path").distinct()
    return declared.join(c.filter("status = 'matched' and resource = 'R'").select("path", F.lit(True).alias("cites")).distinct(), "path", "left").select("path", F.coalesce("cites", F.lit(False)).alias("cites"))


_CHUNK_CASES = """e AS (SELECT path, doc_id % 40 AS k FROM notes), p AS (SELECT path, k, unnest(range(0, greatest((2 * k + 29) // 30, 1))) AS j FROM e WHERE k >= 16)
SELECT path, 'H' AS heading, 0 AS start_line, 1 AS words FROM e
UNION ALL SELECT path, 'Part', 3, 2 * k + 3 FROM e WHERE k < 14
UNION ALL SELECT path, 'Part', 4, 2 * k FROM e WHERE k IN (14, 15)
UNION ALL SELECT path, 'Part', (4 + 15 * j)::INT, least(30, 2 * k - 30 * j)::INT FROM p
UNION ALL SELECT path, 'Deep', 4 + k, 1 FROM e WHERE k >= 14"""


@query(_CHUNK_CASES.replace("doc_id % 40 AS k", "(doc_id % 40)::INT AS k"))
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections under a word budget: whole, cut at the next level, and cut at lines, as a note's length has it."""
    lines = F.repeat(F.lit("line word\n"), (F.col("doc_id") % 40).cast("int"))
    body = F.concat(F.lit("# H\nintro\n\n## Part\n"), lines, F.lit("### Deep\nend\n"))
    own = _written(spark, sf, "sections", body, short_lines=0, max_chunk_words=30, overlap_words=0)
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return own.select("path", "heading", "start_line", words.alias("words"))


@query("""e AS (SELECT path, 1 AS k FROM notes UNION ALL SELECT path, 2 FROM notes) SELECT path, k - 1 AS ordinal, CASE k WHEN 1 THEN 'a1 a2 a3' || chr(10) ELSE 'a2 a3' || chr(10) || chr(10) || 'b1 b2 b3' || chr(10) END AS content FROM e""")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    own = _written(spark, sf, "sections", F.lit("a1 a2 a3\n\n\nb1 b2 b3\n"), max_chunk_words=4, overlap_words=2)
    return own.select("path", "ordinal", "content")


@query(X + "SELECT path, 0 AS ordinal, length(text)::INT AS chars FROM notes")
def chunk_whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    own = _written(spark, sf, "sections", F.col("text"), F.concat(F.lit("n: "), F.col("doc_id").cast("string")), chunker=markdown.WholeDocumentChunker())
    return own.select("path", "ordinal", F.length("content").alias("chars"))


@query("""e AS (SELECT path, doc_id, doc_id % 4 AS c FROM notes) SELECT path, CASE c WHEN 0 THEN 'Front ' || doc_id WHEN 1 THEN 'Head ' || doc_id WHEN 2 THEN doc_id::VARCHAR ELSE 'Field ' || doc_id END AS title FROM e""")
def title_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """From the configured field, the title, the first H1 or the file's name."""
    front = _case(4, "title: Front {i}", "tags: [a]", "tags: [a]", "name: Field {i}\ntitle: no")
    body = _case(4, "# Head {i}\n", "```\n# code\n```\n## Sub\n# Head {i}\n", "## Sub\n", "# Head {i}\n")
    return _written(spark, sf, "documents", body, front, title_field="name").select("path", "title")


@query("""e AS (SELECT path, doc_id % 5 AS c FROM notes) SELECT path, CASE c WHEN 0 THEN 'parse_error' WHEN 1 THEN 'decode_error' WHEN 2 THEN 'missing_frontmatter' END AS skip_category FROM e""")
def parse_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Files that can't be read as notes keep a row with the reason."""
    ok = F.concat(F.lit("---\ntitle: T\n---\n"), F.col("text")).cast("binary")
    kind = F.col("doc_id") % 5
    content = F.when(kind == 0, F.lit("---\n: [\n---\nx").cast("binary")).when(kind == 1, F.unhex(F.lit("FF41"))).when(kind == 2, F.lit("no front").cast("binary")).otherwise(ok)
    files = notes(spark, sf).select("path", F.col("modified_at").alias("mtime"), content.alias("content"))
    return source.tables(source.parse(files, source.ParseOptions(required_fields=("title",))))["documents"].select("path", "skip_category")


@query(X + "SELECT path, 'Alias ' || doc_id AS alias FROM notes WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'Other' FROM notes WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'Single ' || doc_id FROM notes WHERE doc_id % 2 = 1")
def parse_aliases(spark: SparkSession, sf: str) -> DataFrame:
    front = _case(2, "aliases: [Alias {i}, Other, Alias {i}]", "alias: Single {i}")
    return _written(spark, sf, "aliases", F.lit("x\n"), front).select("path", "alias")


@query("""e AS (SELECT path, doc_id FROM notes) SELECT path, 0 AS position, 'Top ' || doc_id AS heading, 1 AS heading_level FROM e
UNION ALL SELECT path, 1, 'Second', 2 FROM e UNION ALL SELECT path, 2, 'Skipped', 4 FROM e UNION ALL SELECT path, 3, 'Last #', 3 FROM e WHERE doc_id % 2 = 0""")
def parse_headings_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Skipped levels, fences of both kinds, lines that only look like headings."""
    body = _case(2, "# Top {i}\n## Second\n~~~\n# no\n~~~\n#### Skipped\n#no\n### Last #\n", "# Top {i}\n````\n# no\n```\n# no\n````\n## Second\n####### no\n #### no\n#### Skipped\n")
    return _written(spark, sf, "headings", body).select("path", "position", "heading", "heading_level")


# --- history and packing --------------------------------------------------------------------


@query("""c AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 5 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM notes)
SELECT change, count(*) AS n FROM c GROUP BY change""")
def reindex_counters(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    edited = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash"))
    return history.change_counts(history.change_set(own.filter("doc_id % 10 <> 3"), own.filter("doc_id % 10 <> 5").withColumn("content_hash", edited)))


@query("s AS (SELECT path FROM notes WHERE starts_with(folder, 'es/') OR path = (SELECT path FROM notes ORDER BY doc_id LIMIT 1)) SELECT path, (SELECT greatest(count(*) - 30, 0) FROM s) AS left_out FROM s ORDER BY path LIMIT 30")
def summary_scope(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    found, left = history.expand_scope(own, ["es"], [own.orderBy("doc_id").first().path], 30)
    return spark.createDataFrame([(p, left) for p in found], "path string, left_out long")


# --- text functions over columns ------------------------------------------------------------


def _each(kind: str, function, *columns: Column) -> Column:
    """A function of Python values over columns, batch by batch."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


@query(X + """SELECT path, 'See [x](../../new/b' || doc_id || '.md#p "T"), [[b' || doc_id || '|B]], [y](/other.md) and `[x](b' || doc_id || '.md)`.' || chr(10) || chr(10) || '[r]: ../../new/b' || doc_id || '.md' || chr(10) || '[r]' AS text FROM notes""")
def links_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Links to a moved note follow it, each in its own spelling; code and other links stay."""

    def moved(text: str, path: str, folder: str, number: int) -> str:
        return markdown.rewrite_links(text, path, {f"{folder}/b{number}.md": f"new/b{number}.md"})

    body = _case(1, 'See [x](b{i}.md#p "T"), [[b{i}|B]], [y](/other.md) and `[x](b{i}.md)`.\n\n[r]: b{i}.md\n[r]')
    return notes(spark, sf).select("path", _each("string", moved, body, F.col("path"), F.col("folder"), F.col("doc_id")).alias("text"))


@query(X + "SELECT path, '[Alias](../../t/T' || doc_id || '.md) [[gone]] [T' || doc_id || '#s](../../t/T' || doc_id || '.md#s)' AS text FROM notes")
def wikilinks_converted(spark: SparkSession, sf: str) -> DataFrame:
    def convert(text: str, path: str, number: int) -> str:
        return markdown.wikilinks_to_markdown(text, path, {f"T{number}.md": f"t/T{number}.md"})[0]

    body = _case(1, "[[T{i}|Alias]] [[gone]] [[T{i}#s]]")
    return notes(spark, sf).select("path", _each("string", convert, body, F.col("path"), F.col("doc_id")).alias("text"))


_OUTLINE = "# Title {i}\nintro\n## A  B\none {i}\n### Deep\ntwo\n## C\nthree\n"


@query(X + "SELECT path, '1 Title ' || doc_id || ',2 A  B,2 C' AS toc FROM notes")
def table_of_contents(spark: SparkSession, sf: str) -> DataFrame:
    def toc(body: str, title: str) -> str:
        found = markdown.outline(title, [(level, text) for level, text, _ in markdown.headings(body)], 2)
        return ",".join(f"{level} {text}" for level, text in found)

    title = F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    return notes(spark, sf).select("path", _each("string", toc, _case(1, _OUTLINE), title).alias("toc"))


@query(X + "SELECT path, '## A  B' || chr(10) || 'one ' || doc_id || chr(10) || '### Deep' || chr(10) || 'two' || chr(10) AS section FROM notes")
def section_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("path", _each("string", lambda body: markdown.section(body, " A B "), _case(1, _OUTLINE)).alias("section"))


@query(X + "SELECT path, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END AS at, doc_id % 2 = 0 AS found FROM notes")
def edits_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Where an edit's text occurs once dashes, quotes and blanks are evened out within lines."""

    def place(text: str) -> int:
        found = find_normal(text, 'say "a - b" now')
        return found[0][0] if found else -1

    at = _each("int", place, _case(2, "So,\n say “a  – b”\tnow {i}", "say “a\n- b” now {i}"))
    return notes(spark, sf).select("path", at.alias("p")).select("path", F.greatest("p", F.lit(0)).alias("at"), (F.col("p") >= 0).alias("found"))


@query(X + "SELECT path, modified_at::BIGINT::DOUBLE AS instant FROM (SELECT path, floor(modified_at) AS modified_at FROM notes WHERE modified_at > 0)")
def instants_parsed(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.floor("modified_at")
    text = F.concat(F.date_format(F.timestamp_seconds(whole + 7200), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return notes(spark, sf).filter("modified_at > 0").select("path", _each("double", parse_instant, text).alias("instant"))


@query("""e AS (SELECT path, doc_id % 6 AS c FROM notes) SELECT path, CASE c WHEN 0 THEN 'expired' WHEN 1 THEN 'unexpired' WHEN 2 THEN 'malformed' ELSE 'missing' END AS freshness, c = 0 AS stale,
CASE c WHEN 3 THEN 'human-reviewed' WHEN 4 THEN 'machine-confirmed' ELSE 'unverified' END AS trust_tier, CASE c WHEN 3 THEN 'recorded' WHEN 4 THEN 'recorded' WHEN 5 THEN 'malformed' ELSE 'missing' END AS review FROM e""")
def metadata_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Staleness, trust and evidence from front matter that varies."""
    front = _case(
        6,
        "stale_after: 2001-01-01",
        "stale_after: 2999-01-01T00:00:00Z",
        "stale_after: soon",
        "verified: [{by: 'process:ci', at: '2024-01-01T00:00:00Z'}, {by: 'human:ann', at: '2024-01-02T00:00:00Z'}]",
        "verified: {by: 'tool/v1', at: '2024-01-01T00:00:00Z'}",
        "verified: [{by: nobody}]",
    )
    return _written(spark, sf, "okf", F.lit("x\n"), front).select("path", "freshness", "stale", "trust_tier", "review")


@query("""e AS (SELECT path, doc_id % 3 AS c FROM notes), r AS (SELECT path, unnest(CASE c WHEN 0 THEN ['missing_recommended', 'missing_freshness', 'unknown_status'] WHEN 1 THEN ['missing_type', 'missing_recommended', 'wikilink_files', 'malformed_sources', 'missing_freshness'] ELSE ['malformed_freshness', 'malformed_review'] END) AS rule FROM e)
SELECT rule, count(*) AS n FROM r GROUP BY rule""")
def audit_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of notes whose front matter breaks different rules."""
    front = _case(3, "type: note\nstatus: odd", "sources: [{id: a}]", "type: note\ntitle: T\ndescription: D\nstale_after: soon\nverified: [{by: nobody}]")
    body = _case(3, "x\n", "[[W]]\n", "x\n")
    return _written(spark, sf, "okf", body, front).select(F.explode("findings").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(X + "SELECT path, 'T' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'H' || chr(10) ELSE '' END || chr(10) || text AS input FROM notes")
def embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    """The text that stands for a chunk: title and heading, an empty line, the content."""
    rows = notes(spark, sf).select("path", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "H").alias("heading"), F.col("text").alias("content"))
    return rows.select("path", vector.embedding_text(rows).alias("input"))


@query("""e AS (SELECT path, doc_id FROM notes) SELECT path, 'ambiguous' AS status, 2 AS occurrences, 'a' AS duplicate, 1 AS unkeyed FROM e""")
def citations_inspected(spark: SparkSession, sf: str) -> DataFrame:
    def inspect(text: str) -> str:
        found = markdown.inspect_citations(text)
        own = found["citations"][0]
        return f"{own['status']} {own['occurrences']} {found['duplicate_ids'][0]} {len(found['unkeyed_source_indices'])}"

    body = _case(1, "---\nsources: [{id: a, resource: R{i}}, {id: a}, {resource: S}]\n---\nOne[^a], `[^a]`, two[^a].\n")
    parts = F.split(_each("string", inspect, body), " ")
    return notes(spark, sf).select("path", parts.alias("p")).select("path", F.col("p")[0].alias("status"), F.col("p")[1].cast("int").alias("occurrences"), F.col("p")[2].alias("duplicate"), F.col("p")[3].cast("int").alias("unkeyed"))


_WORDS = ("Connected connections, node", "connecting {i}", "other words here", "nothing of it {i}", "Connexion déjà vu")


@query("""e AS (SELECT path, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS f, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS dl FROM notes),
t AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f > 0) AS d FROM e)
SELECT path, 0 AS ordinal, round(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM e, t WHERE f > 0""")
def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """A word finds the other forms of its stem, over the terms that vaults are indexed by."""
    rows = notes(spark, sf).select("path", F.lit(0).alias("ordinal"), _case(5, *_WORDS).alias("content"))
    postings, lengths = fulltext.build_postings(rows, ("content",))
    return fulltext.bm25(postings, lengths, parse_lenient("Connection", ("content",))).select("path", "ordinal", _r("score"))


@query("""e AS (SELECT path, doc_id % 5 AS c, doc_id FROM notes), w AS (SELECT path, unnest(CASE c WHEN 0 THEN ['connect', 'node'] WHEN 1 THEN ['connect', doc_id::VARCHAR] WHEN 2 THEN ['other', 'word', 'here'] WHEN 3 THEN ['noth', 'of', 'it', doc_id::VARCHAR] ELSE ['connexion', 'deja', 'vu'] END) AS term, c FROM e)
SELECT path, term, CASE WHEN c = 0 AND term = 'connect' THEN 2 ELSE 1 END AS tf FROM w""")
def stemmed_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = notes(spark, sf).select("path", F.lit(0).alias("ordinal"), _case(5, *_WORDS).alias("content"))
    return fulltext.build_postings(rows, ("content",))[0].select("path", "term", "tf")


@query(X + "SELECT path, CASE WHEN doc_id % 2 = 0 THEN '… f g connected …' ELSE 'a linked, connections …' END AS snippet FROM notes")
def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = notes(spark, sf).select("path", _case(2, "a b c d e f g connected h i", "a linked, connections d e f g").alias("content"))
    return fulltext.add_snippets(rows, fulltext.query_terms("connection OR linking"), 3).select("path", "snippet")


@query("""e AS (SELECT path, doc_id, doc_id % 3 AS c FROM notes) SELECT path, CASE c WHEN 0 THEN 'a ' || doc_id WHEN 1 THEN '["x",' || doc_id || ']' END AS value FROM e""")
def frontmatter_values(spark: SparkSession, sf: str) -> DataFrame:
    """Any front-matter key, read back from the stored JSON."""
    front = _case(3, "my key: a {i}", "my key: [x, {i}]", "other: 1")
    return population.frontmatter_values(_written(spark, sf, "documents", F.lit("x\n"), front), "my key")
