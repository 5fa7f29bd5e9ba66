"""A vault on disk: build, queries, refresh, moves, search, vectors, history, stream."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from notelake.functions.fts_query import parse
from notelake.model import DocumentFilter
from notelake.operators import fulltext, graph, history, population, vector
from notelake.plans.snapshot import Conflict, SnapshotStore
from notelake.plans.vault import EditError, Vault
from notelake.sources import vault as source
from notelake.sources.vault import ParseOptions

NOTES = {
    "index.md": "---\ntitle: Home\ntags: [a, b]\n---\n# Home\n[one](notes/one.md) [[two]]\n",
    "notes/one.md": "---\ntags: a\nstatus: deprecated\naliases: [Uno]\n---\n# One\nThe quick brown fox jumps. [back](../index.md) [gone](missing.md)\n",
    "notes/two.md": "# Two\nA lazy dog sleeps. [[Uno]] [^s]\n",
    "notes-extra/three.md": "# Three\nQuick foxes and dogs.\n",
    ".hidden/four.md": "hidden note\n",
    "bad.md": "---\na: [\n---\nx\n",
    "straße.md": "# Straße\nlonely\n",
}


def write(root, notes):
    for name, text in notes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "vault"
    write(root, NOTES)
    v = Vault(spark, str(root), str(tmp_path / "store"), embed=lambda texts: [vector.hash_embedding(t, 32) for t in texts])
    v.build()
    return v


def paths(df, col="path"):
    return [r[col] for r in df.collect()]


def test_build_and_exact_queries(vault):
    assert vault.count_documents(DocumentFilter()) == 6
    assert paths(population.skipped(vault.documents)) == ["bad.md"]
    assert paths(population.listing(vault.documents, folder="notes")) == ["notes/one.md", "notes/two.md"]
    assert vault.count_documents(DocumentFilter(tags=(("tags", "a"),))) == 2
    assert vault.count_documents(DocumentFilter(path_contains="STRASSE")) == 1
    groups = {r.key: r.n for r in vault.aggregate_documents(DocumentFilter(), "tag", "tags").collect()}
    assert groups == {None: 4, "a": 2, "b": 1}
    page, total = vault.query_documents(DocumentFilter(query="fox", scope="body"), sections=1)
    assert total == 2 and {r.path for r in page.collect()} == {"notes/one.md", "notes-extra/three.md"}
    assert vault.count_documents(DocumentFilter(query="fox", scope="metadata")) == 0
    assert vault.toc("notes/one.md") == [(1, "One")]
    assert vault.read("none.md") is None and "fox" in vault.read_section("notes/one.md", "One")
    assert vault.stats()["broken_links"] == 1


def test_graph(vault):
    links, docs = vault.links, vault.documents
    assert paths(graph.backlinks(links, docs, "notes/one.md"), "source_path") == ["index.md", "notes/two.md"]
    assert paths(graph.broken_links(links, docs), "target_path") == ["notes/missing.md"]
    assert set(paths(graph.orphans(links, docs))) == {"notes-extra/three.md", ".hidden/four.md", "straße.md"}
    assert graph.shortest_path(links, docs, "notes/two.md", "index.md") == ["notes/two.md", "index.md"]
    assert graph.shortest_path(links, docs, "index.md", "straße.md") is None
    nodes, edges = graph.neighbourhood(links, docs, "index.md", 1)
    assert nodes.count() == 3 and edges.count() == 4
    assert graph.hub_graph(links, docs, 1).count() == 2
    assert set(graph.context("notes/one.md", links, docs, vault.table("tags"))) == {"backlinks", "outlinks", "peers", "tags"}


def test_search_modes(vault):
    vault.build_vectors()
    assert vault.search("  ") is None
    found = vault.search("quick fox", mode="keyword", snippet_words=3).collect()
    assert {r.path for r in found} == {"notes/one.md", "notes-extra/three.md"} and "…" in found[0].snippet + found[1].snippet
    hybrid = vault.search("quick fox", mode="hybrid", limit=3).collect()
    assert hybrid and "keyword+semantic" in {r.search_type for r in hybrid}
    assert "notes/one.md" not in paths(vault.similar("notes/one.md", 3))
    assert {r.path for r in vault.search("quick", mode="keyword", okf_filters={"status": "stable"}).collect()} == {"notes-extra/three.md"}
    assert vault.build_vectors()["embedded"] == 0


def test_incremental_refresh(vault, tmp_path):
    root = tmp_path / "vault"
    assert vault.reindex() == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 7}
    (root / "notes/two.md").write_text("# Two\nnow about cats\n")
    (root / "new.md").write_text("# New\n")
    (root / "straße.md").unlink()
    assert vault.reindex() == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 5}
    assert vault.count_documents(DocumentFilter(query="cat")) == 1
    assert vault.table("sections").filter("path = 'straße.md'").isEmpty()


def test_unavailable_notes_keep_their_rows_at_any_number(vault, spark, tmp_path):
    import shutil

    n = 100_200
    one = vault.documents.filter("path = 'notes/one.md'").drop("path")
    many = spark.range(n).select(F.concat(F.lit("notes/x"), "id", F.lit(".md")).alias("path")).crossJoin(one).select(*vault.documents.columns)
    found = vault.store.manifest()
    vault.store.publish(vault.store.tables() | {"documents": vault.documents.unionByName(many)}, found["fingerprint"], found["generation"], found["markers"])
    shutil.rmtree(tmp_path / "vault/notes")
    (tmp_path / "vault/notes").write_text("no folder any more, so that what was below can't be asked for")
    (tmp_path / "vault/straße.md").unlink()
    assert vault.reindex()["deleted"] == n + 3
    assert vault.documents.filter("path like 'notes/%'").count() == n + 2
    assert vault.documents.filter("path = 'straße.md'").isEmpty()


def test_empty_folder_keeps_the_index(vault, tmp_path):
    import shutil

    shutil.rmtree(tmp_path / "vault")
    (tmp_path / "vault").mkdir()
    for refresh in (vault.build, vault.reindex):
        with pytest.raises(RuntimeError):
            refresh()
    assert vault.count_documents(DocumentFilter()) == 6


def test_write_edit_move(vault, tmp_path):
    etag = vault.read("notes/one.md")["etag"]
    vault.edit("notes/one.md", "quick brown", "slow red", etag)
    with pytest.raises(RuntimeError):
        vault.append("notes/one.md", "x", etag)
    with pytest.raises(EditError) as e:
        vault.edit("notes/one.md", "The slow red fix jumps.", "")
    assert e.value.hint is None or e.value.hint["line"]
    rewritten = vault.move({"notes/one.md": "deep/uno.md"})
    assert "index.md" in rewritten and "(deep/uno.md)" in (tmp_path / "vault/index.md").read_text()
    assert "(../index.md)" in (tmp_path / "vault/deep/uno.md").read_text()
    assert vault.flush()["added"] == 1
    with pytest.raises(FileExistsError):
        vault.move({"index.md": "notes/two.md"})
    with pytest.raises(ValueError):
        vault.write("../out.md", "")
    assert vault.export(str(tmp_path / "out.zip")) == 6


def test_notes_over_the_read_cap(vault, tmp_path):
    from notelake.plans import maintenance

    text = "# Long\n[[two]]\n" + "word " * 60_000 + "\n# Last\nthe end\n"
    vault.write("long.md", text)
    vault.flush()
    with pytest.raises(ValueError, match="read a section"):
        vault.read("long.md")
    assert vault.read_section("long.md", "Last").endswith("the end\n")
    etag = vault.append("long.md", "more\n", vault.edit("long.md", "the end", "an end"))
    assert maintenance.convert_links(vault)[0] >= 1 and "[two](notes/two.md)" in (tmp_path / "vault/long.md").read_text()
    with pytest.raises(RuntimeError):
        vault.delete("long.md", etag)
    vault.delete("long.md")
    assert not (tmp_path / "vault/long.md").exists()


def test_okf_and_citations(vault):
    rules = {r.rule: r.n for r in vault.okf_audit().collect()}
    assert rules["unparseable_frontmatter"] == 1 and rules["wikilink_files"] == 1 and rules["missing_type"] == 5
    assert {r.status: r["count"] for r in vault.okf_stats()["status"].collect()} == {"deprecated": 1, "stable": 5}
    vault.write("cite.md", "---\nsources: [{id: s, resource: R}]\n---\nx[^s]\n")
    vault.flush()
    assert [(r.label, r.status) for r in vault.citing("R").collect()] == [("", "declared"), ("s", "matched")]


def test_stream_refresh(vault, tmp_path):
    from notelake.streaming.refresh import watch

    (tmp_path / "vault/new.md").write_text("# New\n")
    seen = []
    query = watch(vault, str(tmp_path / "checkpoint"), once=True, done=seen.append)
    query.awaitTermination(120)
    assert seen and seen[0]["added"] == 1


def test_store_conflicts(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "t1", 0), ("b", "t1", 0)], "path string, token string, ordinal int")
    store.publish({"vectors": rows})
    with pytest.raises(Conflict):
        store.publish({"vectors": rows}, expected=0)
    with pytest.raises(ValueError):
        store.publish({"vectors": rows.unionByName(rows)}, unique={"vectors": ["path", "ordinal"]})
    late = spark.createDataFrame([("a", "t0", "t2", 0), ("b", "t1", "t2", 0)], "path string, expected_token string, token string, ordinal int")
    outcome = {r.path: r.outcome for r in store.replace_vectors(late)[1].collect()}
    assert outcome == {"a": "conflict", "b": "published"}
    assert {r.path: r.token for r in store.read("vectors").collect()} == {"a": "t1", "b": "t2"}
    assert not store.compact()


def test_scan_rules(spark, tmp_path):
    write(tmp_path, {"a.md": "x", "skip/b.md": "x", "c/node/d.md": "x", "e.MD": "x", "p.png": "x", ".h/q.png": "x"})
    assert list(source.walk(str(tmp_path), excludes=["skip/**", "**/node/**"])) == ["a.md"]
    assert paths(source.attachments(spark, str(tmp_path))) == ["p.png"]
    assert source.probe(str(tmp_path), "zz.md") == ("absent", None)
    assert source.probe(str(tmp_path / "none"), "a.md") == ("unavailable", None)
    assert source.read_attachment(str(tmp_path), "p.png")["mime"] == "image/png"
    row = source.parse_note("a.md", 0.0, b"\xff", ParseOptions())
    assert row["skip_category"] == "decode_error"
    assert source.parse_note("a.md", 0.0, b"x", ParseOptions(required_fields=("t",)))["skip_category"] == "missing_frontmatter"


def test_imports(spark, tmp_path):
    import sqlite3

    import numpy as np

    np.save(tmp_path / "m.npy", np.eye(2, dtype="f4"))
    (tmp_path / "m.json").write_text(json.dumps([{"path": "a"}, {"path": "b", "ordinal": 1}]))
    assert source.import_numpy(spark, str(tmp_path / "m.npy"), str(tmp_path / "m.json")).count() == 2
    with sqlite3.connect(tmp_path / "v.db") as db:
        db.execute("CREATE TABLE chunks(path, ordinal, folder, vector)")
        db.execute("INSERT INTO chunks VALUES ('a', 0, '', ?)", (np.ones(2, dtype="<f4").tobytes(),))
    assert source.import_sqlite(spark, str(tmp_path / "v.db")).first().embedding == [1.0, 1.0]


def test_git_history(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.md").write_text("one\ntext that is long enough to follow\n")
    git("add", ".")
    git("commit", "-qm", "first")
    git("mv", "a.md", "b.md")
    git("commit", "-qm", "second")
    commits = source.git_log(spark, str(tmp_path))
    assert [r.subject for r in history.history(commits, path="b.md").collect()] == ["second"]
    assert history.by_day(commits).count() == 1
    assert source.lineage(str(tmp_path), "b.md") == ["a.md"]
    assert source.git_show(str(tmp_path), "b.md", "HEAD~1").startswith(b"one")
    assert "rename" in source.git_diff(str(tmp_path), ".", "HEAD~1")
    assert source.git_commit_diff(str(tmp_path), ".", "HEAD") == source.git_diff(str(tmp_path), ".", "HEAD~1")
    assert source.git_diff(str(tmp_path), ".", "HEAD~1", cap=5).endswith("[cut]")


def test_history_is_whole_and_follows_renames(spark, tmp_path):
    def git(*args, **kw):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, **kw)

    git("init", "-q", "-b", "main")
    (tmp_path / "a.md").write_text("one\ntext that is long enough to follow\n")
    git("add", ".")
    git("commit", "-qm", "first")
    git("mv", "a.md", "b.md")
    git("commit", "-qm", "second")
    stream = "".join(f"commit refs/heads/main\ncommitter n <e@x> {2_000_000_000 + k} +0000\ndata 1\nx\n" + ("from refs/heads/main^0\n" if not k else "") + f"M 644 inline c.md\ndata {len(str(k))}\n{k}\n" for k in range(1100))
    git("fast-import", "--quiet", input=stream.encode())
    assert source.git_log(spark, str(tmp_path)).count() == 1102 and source.git_log(spark, str(tmp_path), 5).count() == 5
    own = Vault(spark, str(tmp_path), str(tmp_path / "store"))
    assert sorted(r.subject for r in own.history("b.md").collect()) == ["first", "second"]
    assert own.history("b.md", since=2_000_000_000.0).isEmpty() and own.history(limit=100).count() == 100


def test_export_holds_attachments(vault, tmp_path):
    import zipfile

    (tmp_path / "vault/notes/p.png").write_bytes(b"\x89PNG")
    assert vault.export(str(tmp_path / "out.zip")) == 6
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.read("notes/p.png") == b"\x89PNG" and len(z.namelist()) == 7 and z.namelist() == sorted(z.namelist())


def test_keyword_scores_match_sqlite(spark):
    import sqlite3

    rows = [("a", 0, "the quick brown fox", "fox title"), ("b", 0, "lazy dogs and foxes running", ""), ("c", 0, "nothing here", "quick"), ("d", 0, "the fox the fox quick", "x")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, title, tokenize='porter unicode61')")
    for n, r in enumerate(rows):
        db.execute("INSERT INTO t(rowid, content, title) VALUES (?, ?, ?)", (n, r[2], r[3]))
    df = spark.createDataFrame(rows, "path string, ordinal int, content string, title string")
    postings, lengths = fulltext.build_postings(df, ("content", "title"))
    for q in ("fox", "quick AND fox", "quick OR dog", '"the fox"', "fox NOT lazy", "qui*", "title: fox", "^quick", "NEAR(quick fox, 1)", '"quick brown" + fox'):
        wanted = {rows[n][0]: -s for n, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (q,))}
        found = {r.path: r.score for r in fulltext.bm25(postings, lengths, parse(q, ("content", "title"))).collect()}
        assert found.keys() == wanted.keys(), q
        assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted), q


def test_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0, "f", [3.0, 4.0]), ("b", 0, "f/g", [1.0, 0.0]), ("c", 0, "x", [0.0, 0.0])], "path string, ordinal int, folder string, embedding array<float>")
    own = vector.normalise(rows, 2)
    assert [(r.path, round(r.score, 6)) for r in vector.semantic(own, [2.0, 0.0], 3).collect()] == [("b", 1.0), ("a", 0.6), ("c", 0.0)]
    assert paths(vector.semantic(own, [2.0, 0.0], 3, folder="f")) == ["b", "a"]
    with pytest.raises(Exception, match="bad vector"):
        vector.normalise(rows.withColumn("embedding", F.array(F.lit(float("nan")), F.lit(1.0))), 2).collect()
    assert paths(vector.similar(own, "a", 5)) == ["b", "c"]
    asked = own.select(F.col("path").alias("query_id"), F.col("embedding").alias("query"))
    best = [tuple(r) for r in vector.batch_semantic(own, asked, 1).orderBy("query_id").select("query_id", "path").collect()]
    monkeypatch.setattr(vector, "MOST_SENT", 1)
    assert best == [("a", "a"), ("b", "b"), ("c", "a")] == [tuple(r) for r in vector.batch_semantic(own, asked, 1).orderBy("query_id").select("query_id", "path").collect()]


def test_batch_search_takes_every_query(spark, monkeypatch):
    from notelake import queries
    from tests.conftest import SF

    sent = queries.vector_batch(spark, SF).toPandas()
    wanted = {r.path for r in queries.vectors(spark, SF).filter("vec_id % 20 = 0").collect()}
    assert set(sent.query_id) == wanted and set(sent.groupby("query_id").size()) == {10}
    monkeypatch.setattr(vector, "MOST_SENT", 7)
    monkeypatch.setattr(vector, "BLOCK", 100)
    by_blocks = queries.vector_batch(spark, SF).toPandas()
    order = ["query_id", "rank"]
    assert by_blocks.sort_values(order).values.tolist() == sent.sort_values(order).values.tolist()


def test_fusion_ranks_whole_channels(spark):
    from notelake.operators import ranking

    def channel(scores):
        rows = [(f"n{k:03}", 0, None, "f", 1, float(s)) for k, s in scores]
        return spark.createDataFrame(rows, "path string, ordinal int, heading string, folder string, chunk_count int, score double").repartition(7)

    keyword, semantic = channel((k, -(k // 2)) for k in range(500)), channel((k, k) for k in range(500))
    found = {r.path: (r.rank, r.channel) for r in ranking.ranked(keyword, "keyword", None).collect()}
    assert found == {f"n{k:03}": (k + 1, "keyword") for k in range(500)}
    fused = {r.path: r.score for r in ranking.hybrid(keyword, semantic, 500, 1, whole=True).collect()}
    assert len(fused) == 500 and all(abs(fused[f"n{k:03}"] - 1 / (61 + k) - 1 / (560 - k)) < 1e-12 for k in range(500))
    assert ranking.ranked(keyword.limit(0), "keyword", None).count() == 0


def test_cutting_loses_no_word_of_any_note(spark, tmp_path):
    import duckdb

    from notelake import queries

    line = "tab\tcr\rnbsp\xa0“quoted” – dash 🙂 Ελληνικά кириллица 漢字\u3000かな\x1cfs\x85nel\u2028ls\x0bvt\n"
    texts = [line * 60, "# A b\nwords\n## C\n" + line * 40, "---\nx: 1\n---\nbody text\n", '{"a": 1}\n\nrest', "+++\nx\n+++\n", "\ufeffmark", "", " \n", "plain words", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {f"en/s/{k}.md": len((t or "").split()) for k, t in enumerate(texts)}
    assert {r.path: r.words for r in queries.chunk_budget(spark, str(tmp_path)).collect()} == wanted
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    own = queries.ORACLE["chunk_budget"].split(",\ntags AS")[0] + " SELECT" + queries.ORACLE["chunk_budget"].rpartition(" SELECT")[2]
    assert dict(db.execute(own).fetchall()) == wanted


def test_fuzzy_paths_and_limits(spark):
    docs = spark.createDataFrame([("notes/meeting.md",), ("notes/meting-2.md",), ("other.md",)], "path string").withColumn("path_folded", F.lower("path"))
    assert [(r.path, r.tier) for r in population.path_search(docs, "Meeting").collect()] == [("notes/meeting.md", 2), ("notes/meting-2.md", 3)]
    assert population.path_search(docs, "meeting", candidates=1).count() == 1
    with pytest.raises(ValueError):
        history.history(docs, limit=0)


def test_summaries():
    assert history.pack([("a", 5), ("b", 4), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]
    out = history.summarize({str(k): "x" * 10 for k in range(10)}, lambda s, u: u[:3], 25)
    assert len(out) == 3


def test_one_edit_writes_one_bucket_and_embeds_one_text(spark, tmp_path):
    asked = []

    def embed(texts):
        asked.extend(texts)
        return [[float(len(t)), 1.0] for t in texts]

    root = tmp_path / "notes"
    root.mkdir()
    write(root, {f"n{k}.md": f"# N{k}\n" + "\n".join(f"line {k} {i}" for i in range(40)) + f"\n## Two\nmore {k}\n" for k in range(6)})
    vault = Vault(spark, str(root), str(tmp_path / "store"), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    vault.build()
    first = vault.build_vectors()
    assert first["embedded"] == 12 and first["reused"] == first["failed"] == 0
    before = vault.store.manifest()["tables"]
    write(root, {"n3.md": (root / "n3.md").read_text().replace("more 3", "changed 3")})
    assert vault.reindex()["modified"] == 1
    after = vault.store.manifest()["tables"]
    for name in ("documents", "sections", "postings", "links"):
        assert sum(after[name]["buckets"].get(k) != f for k, f in before[name]["buckets"].items()) <= 1, name
    assert after["vectors"] == before["vectors"]
    assert vault.build_vectors() | {"removed_paths": 0} == {"reused": 11, "embedded": 1, "failed": 0, "removed_paths": 0}
    assert not list((tmp_path / "store" / "stage").iterdir())


def test_two_writers_cannot_both_win(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path / "s")), SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    one.publish({"t": rows})
    held = two.manifest()
    assert one.files.create("manifests/000000000002.json", "{}") and not two.files.create("manifests/000000000002.json", "x")
    one.files.drop("manifests/000000000002.json")
    one.upsert({"t": spark.createDataFrame([("a", 9)], "path string, n int")}, rows.select("path").filter("path = 'a'"))
    with pytest.raises(Conflict):
        two._commit(held["generation"], {}, "", None)
    with pytest.raises(Conflict):
        two.upsert({"t": rows}, rows.select("path"), expected=held["generation"])
    assert {(r.path, r.n) for r in two.read("t").collect()} == {("a", 9), ("b", 2)}


def test_old_generations_go_but_not_under_readers(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), keep=1, grace=0.0)
    rows = spark.createDataFrame([(str(k), k) for k in range(40)], "path string, n int")
    store.publish({"t": rows})
    for k in range(3):
        store.upsert({"t": spark.createDataFrame([("7", 100 + k)], "path string, n int")}, rows.select("path").filter("path = '7'"))
    assert store._numbers() == [4] and {r.n for r in store.read("t").collect()} == {102, *range(40)} - {7}
    patient = SnapshotStore(spark, str(tmp_path / "p"), keep=1)
    patient.publish({"t": rows})
    held = patient.read("t")
    patient.publish({"t": rows.limit(1)})
    assert held.count() == 40 and patient.read("t").count() == 1
