"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Keyword, vector and graph queries run over stored derived tables, as a vault's do; building those
is timed on its own. Every query runs once to warm up, then $BENCH_RUNS times; its best time counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from notelake import queries as Q
from notelake.functions.fts_query import parse
from notelake.model import DocumentFilter
from notelake.operators import fulltext, graph, history, population, ranking, vector
from notelake.session import local_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "6g"))
    folder = tempfile.mkdtemp(prefix="notelake-bench-")
    times: dict[str, float] = {}

    def store(name: str, df):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    try:
        began = time.time()
        for name in os.listdir(sf):  # one file of one row group each: loading deals them out
            spark.read.parquet(f"{sf}/{name}").repartition(cpus).write.parquet(f"{folder}/tables/{name}")
        sf_name, sf = os.path.basename(sf.rstrip("/")), f"{folder}/tables"
        times["load"] = time.time() - began
        began = time.time()
        notes, tags = store("notes", Q.notes(spark, sf).drop("text")), store("tags", Q.tags(spark, sf))
        postings, lengths = Q._index(spark, sf)
        postings, lengths = store("postings", postings.repartitionByRange("term").sortWithinPartitions("term")), store("lengths", lengths)
        vectors, links, nodes = store("vectors", Q.vectors(spark, sf).drop("raw")), store("links", Q.links(spark, sf)), store("nodes", Q.nodes(spark, sf))
        totals = store("totals", lengths.selectExpr("count(1) n", "avg(dl) avg"))
        counted = store("counted", lengths.groupBy("path").count().selectExpr("path", "cast(count as int) chunk_count"))
        times["build_index"] = time.time() - began
        asked = Q._query_vector(spark, sf)

        def search(text: str):
            return fulltext.bm25(postings, lengths, parse(text, ("content", "title")), None, Q._plain, totals)

        def hits(text: str):
            return search(text).join(notes.select("path", "folder"), "path").join(counted, "path").selectExpr("*", "cast(null as string) heading")

        def near():
            return vector.semantic(vectors, asked, 1000).selectExpr("path", "ordinal", "score", "folder", "1 chunk_count", "cast(null as string) heading")

        work = {
            "count_folder": lambda: population.count(population.population(notes, tags, DocumentFilter(folder="en"))),
            "page_by_tag": lambda: population.page(population.population(notes, tags, DocumentFilter(tags=(("lang", "fr"),))), 20),
            "aggregate_by_tag": lambda: population.aggregate(population.group_keys(notes, tags, "tag", "quality")),
            "aggregate_by_month": lambda: population.aggregate(population.group_keys(notes, tags, "month")),
            "path_fuzzy": lambda: population.path_search(notes, "src12"),
            "keyword_term": lambda: ranking.collapse(ranking.length_downweight(hits("tion")), 10),
            "keyword_and": lambda: ranking.collapse(ranking.length_downweight(hits("the AND and")), 10),
            "keyword_phrase": lambda: ranking.collapse(ranking.length_downweight(hits('"of the"')), 10),
            "semantic": lambda: vector.semantic(vectors, asked, 10),
            "semantic_in_folder": lambda: vector.semantic(vectors, asked, 10, folder="3"),
            "similar": lambda: vector.similar(vectors, "4", 10),
            "hybrid": lambda: ranking.hybrid(hits("tion"), near(), 10),
            "backlinks": lambda: graph.backlinks(links, nodes, "nation/3"),
            "broken_links": lambda: graph.broken_links(links, nodes),
            "most_linked": lambda: graph.most_linked(links, nodes, 10),
            "neighbourhood": lambda: graph.neighbourhood(links, nodes, "region/2", 2)[0],
            "link_resolution": lambda: Q.link_resolution(spark, sf),
            "change_set": lambda: Q.change_set(spark, sf),
            "history_by_day": lambda: history.by_day(Q._commits(spark, sf)),
            "summary_pack": lambda: Q.summary_pack(spark, sf),
        }
        for name, query in work.items():
            best = None
            for k in range(runs + 1):
                began = time.time()
                query().write.format("noop").mode("overwrite").save()
                if k:
                    best = min(best or 1e9, time.time() - began)
            times[name] = best
            print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()}, "sf": sf_name}))


if __name__ == "__main__":
    main()
