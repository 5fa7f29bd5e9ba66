"""Refreshing a vault: what is listed and read, links kept resolved, status, embeddings, settled changes."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from notelake.operators import graph, population, vector
from notelake.plans import vault as plan
from notelake.plans.snapshot import Conflict
from notelake.plans.vault import Vault
from notelake.sources import vault as source
from notelake.streaming import settle
from tests.test_vault import write


def texts(n):
    return {f"d{k % 3}/n{k}.md": f"# N{k}\nto [[n{k + 1}]]\n" for k in range(n)}


def old(root, seconds=100):
    """Let all files look written a while ago, so that their times tell."""
    for at, _, names in os.walk(root):
        for name in names:
            os.utime(os.path.join(at, name), (time.time() - seconds,) * 2)


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    write(root, texts(6))
    old(root)
    v = Vault(spark, str(root), str(tmp_path / "store"))
    v.build()
    return v


def test_listing_level_by_level(spark, tmp_path):
    write(tmp_path, {"a.md": "x", "b/c.md": "xyz", "b/d/e/f.md": "é", ".h/g.md": "x", "skip/h.md": "x", "b/node/i.md": "x", "b/x.txt": "x", "é ü/ä.md": "x"})
    (tmp_path / "empty").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path)
    own = {r.path: (r.mtime, r.size) for r in source.listing(spark, str(tmp_path), excludes=("skip/**", "**/node/**")).collect()}
    assert sorted(own) == sorted(source.walk(str(tmp_path), excludes=("skip/**", "**/node/**"))) == sorted(["a.md", "b/c.md", "b/d/e/f.md", ".h/g.md", "é ü/ä.md"])
    assert own["b/c.md"] == (os.stat(tmp_path / "b/c.md").st_mtime, 3) and own["b/d/e/f.md"][1] == 2
    assert source.listing(spark, str(tmp_path / "none")).count() == 0
    stat = source.stat_paths(spark.createDataFrame([("a.md",), ("gone.md",), ("skip/h.md",)], "path string"), str(tmp_path), ("skip/**",))
    assert [r.path for r in stat.collect()] == ["a.md"]


def test_only_what_moved_is_read(vault, spark, tmp_path, monkeypatch):
    root, read = tmp_path / "notes", []
    before = source.scan
    monkeypatch.setattr(source, "scan", lambda files, at: (read.append(sorted(r.path for r in files.collect())), before(files, at))[1])
    kept = sorted(os.listdir(tmp_path / "store/data"))
    assert vault.reindex() == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 6} and read == [[]]
    assert sorted(os.listdir(tmp_path / "store/data")) == kept  # nothing written
    os.utime(root / "d0/n0.md")  # touched, not changed: read once, its time is stored
    assert vault.reindex()["unchanged"] == 6 and read[-1] == ["d0/n0.md"]
    stat = os.stat(root / "d1/n1.md")
    (root / "d1/n1.md").write_text("# N1\nto [[n9]]\n")  # the size and, set back, the time of before
    os.utime(root / "d1/n1.md", (stat.st_atime, stat.st_mtime))
    assert vault.reindex()["modified"] == 0 and vault.reindex(verify=True)["modified"] == 1
    assert vault.reindex(["d2/n2.md", "d2/none.md"])["unchanged"] == 1


def test_only_what_differs_is_parsed_again(spark, tmp_path, monkeypatch):
    """Files written just before a build are read again, as their times can't tell, but only those with another hash or time are parsed."""
    root = tmp_path / "notes"
    root.mkdir()
    write(root, texts(6))
    vault = Vault(spark, str(root), str(tmp_path / "store"))
    vault.build()
    parsed, before = [], source.parse

    def seen(files, *a, **k):
        rows = before(files, *a, **k)
        parsed.append(sorted((r.path, r.known is not None) for r in rows.select("path", "known").collect()))
        return rows

    with monkeypatch.context() as patch:
        patch.setattr(source, "parse", seen)
        write(root, {"d0/n0.md": "# N0 more\nto [[n9]]\n", "d2/new.md": "# New\n"})
        (root / "d1/n1.md").unlink()
        os.utime(root / "d2/n2.md", (1000, 1000))
        assert vault.reindex() == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 4}
    assert parsed == [[("d0/n0.md", True), ("d2/n2.md", True), ("d2/new.md", False)]]
    anew = Vault(spark, str(root), str(tmp_path / "anew"))
    anew.build()
    for name in ("documents", "sections", "headings", "postings", "lengths", "links", "resolved", "names"):
        a, b = vault.table(name), anew.table(name)
        assert a.exceptAll(b).isEmpty() if name != "documents" else True, name
        assert a.count() == b.count(), name
    own = lambda v: sorted((r.path, r.modified_at, r.content_hash) for r in v.documents.collect())
    assert own(vault) == own(anew)


def test_links_stay_as_resolved_anew(vault, spark, tmp_path):
    rng, root = random.Random(3), tmp_path / "notes"
    names = ["n1", "n2", "d1/n1", "d2/n2", "x/d1/n1", "alias one", "Alias ONE", "n7", "n0"]

    def text():
        alias = rng.choice(["", "---\naliases: [alias one]\n---\n", "---\naliases: [n7]\n---\n", "---\na: [\n---\n"])
        return alias + "".join(f"[[{rng.choice(names)}]] [m]({rng.choice(names)}.md) [r](../{rng.choice(names)}.md)\n" for _ in range(3))

    for _ in range(5):
        write(root, {rng.choice(["d1/n1.md", "d2/n1.md", "x/d1/n1.md", "n2.md", "d2/n2.md", "n7.md", "y/n0.md"]): text() for _ in range(3)})
        there = sorted(p.relative_to(root).as_posix() for p in root.rglob("*.md"))
        (root / rng.choice(there)).unlink()
        vault.reindex()
        kept = vault.links.select("source_path", "link_ordinal", "target_path")
        anew = graph.resolve(vault.table("links"), vault.documents, vault.table("aliases")).select(*kept.columns)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, anew.collect()))
    fresh = Vault(spark, str(root), str(tmp_path / "other"))
    fresh.build()
    assert sorted(map(tuple, fresh.links.collect())) == sorted(map(tuple, vault.links.collect()))


def test_only_links_to_what_came_or_went_are_asked(spark):
    links = spark.createDataFrame([("a.md", "x/b.md", "markdown"), ("c.md", "b.md", "wikilink"), ("d.md", "uno.md", "wikilink"), ("e.md", "other.md", "wikilink")], "source_path string, target_path string, link_type string")
    moved, names = spark.createDataFrame([("x/b.md",)], "path string"), spark.createDataFrame([("Uno",)], "alias string")
    assert sorted(r.path for r in graph.changed_meaning(links, moved, names).collect()) == ["a.md", "c.md", "d.md"]


def test_status_tells_of_pending_work(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    write(root, texts(2))
    v = Vault(spark, str(root), str(tmp_path / "store"))
    assert v.status()["offline_changes"] == "not_reconciled" and not v.status()["ready"]
    v.build()
    warm = Vault(spark, str(root), str(tmp_path / "store"))
    assert warm.status()["offline_changes"] == "not_reconciled" and warm.status()["ready"]
    warm.write("new.md", "# New\n")
    assert warm.status()["stale"] and not warm.status()["drained"]
    warm.flush()  # named paths only: nothing is known of the rest
    assert warm.status() | {"markers": 0} == warm.status() | {"markers": 0, "stale": False, "drained": True, "offline_changes": "not_reconciled", "write_generation": 1}
    with warm.progress.running("reindex", whole=True):
        assert warm.status()["offline_changes"] == "reconciling" and warm.status()["in_flight"] == ["reindex"]
    assert warm.status()["offline_changes"] == "reconciled"
    for p in root.rglob("*.md"):
        p.unlink()
    for p in ("d0", "d1"):
        (root / p).rmdir()
    with pytest.raises(RuntimeError):
        v.reindex()
    assert "empty" in v.status()["last_errors"]["reindex"]


def test_a_refresh_starts_again_after_another_writer(vault, tmp_path, monkeypatch):
    write(tmp_path / "notes", {"d0/new.md": "# New\n"})
    before, lost = vault.store.upsert, []

    def upsert(*a, **k):
        if not lost:
            lost.append(1)
            raise Conflict("another writer published first")
        return before(*a, **k)

    monkeypatch.setattr(vault.store, "upsert", upsert)
    assert vault.reindex()["added"] == 1 and lost
    monkeypatch.setattr(vault.store, "upsert", lambda *a, **k: (_ for _ in ()).throw(Conflict("always")))
    write(tmp_path / "notes", {"d0/more.md": "# More\n"})
    with pytest.raises(Conflict):
        vault.reindex()


class Provider:
    def __init__(self, identity, size=2, bad=()):
        self.identity, self.size, self.bad = identity, size, bad

    def __call__(self, asked):
        if any(b in t for b in self.bad for t in asked):
            raise OSError("the provider is down")
        return [vector.hash_embedding(t, self.size) for t in asked]


def test_vectors_of_another_identity_are_not_reused(vault):
    vault.embed = Provider(["p", "one"])
    assert vault.build_vectors()["embedded"] == 6 and vault.build_vectors()["reused"] == 6
    vault.embed = Provider(["p", "two"], 3)
    assert vault.build_vectors() | {"removed_paths": 0} == {"reused": 0, "embedded": 6, "failed": 0, "removed_paths": 0}
    vault.embed = Provider(["p", "two"], 4)  # the same name, but vectors of another length
    write(vault_root(vault), {"d0/new.md": "# New\n"})
    vault.reindex()
    with pytest.raises(vector.BadVector):
        vault.build_vectors()


def vault_root(vault):
    from pathlib import Path

    return Path(vault.root)


def test_a_failed_batch_is_left_for_the_next_run(vault):
    vault.embed, vault.embed_batch = Provider("p", bad=("N3", "N4")), 1
    assert vault.build_vectors() | {"removed_paths": 0} == {"reused": 0, "embedded": 4, "failed": 2, "removed_paths": 0}
    vault.embed = Provider("p")
    assert vault.build_vectors() | {"removed_paths": 0} == {"reused": 4, "embedded": 2, "failed": 0, "removed_paths": 0}
    vault.embed = Provider("other", bad=("N",))
    with pytest.raises(RuntimeError, match="none"):
        vault.build_vectors()


# --- settled changes ------------------------------------------------------------------------


def observe(spark, folder, rows):
    spark.createDataFrame([(p, m, s, t) for p, m, s, t in rows], "path string, mtime double, size long, t double").selectExpr("path", "mtime", "size", "timestamp_seconds(t) seen_at").coalesce(1).write.mode("append").parquet(folder)


def settled_rows(spark, folder):
    return sorted((r.path, r.change, r.size, r.observations) for r in spark.read.schema(settle.SETTLED).parquet(folder).collect())


def test_bursts_settle_once_and_go_on_after_a_restart(spark, tmp_path):
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))

    def run():
        stream = settle.settled(spark.readStream.schema(settle.OBSERVED).parquet(feed), 2000, "0 seconds")
        settle.start(stream, state, out).awaitTermination()

    # a burst of three on a, one on b; c brings the clock forward
    observe(spark, feed, [("a", 1.0, 10, 100.0), ("a", 2.0, 11, 101.0), ("a", 3.0, 12, 102.5), ("b", 1.0, 5, 100.0), ("c", 1.0, 1, 103.0)])
    run()
    assert settled_rows(spark, out) == [("b", "added", 5, 1)]
    # the timer of a, set before the restart, fires; a's burst isn't told twice
    observe(spark, feed, [("c", 1.0, 1, 110.0)])
    run()
    assert settled_rows(spark, out) == [("a", "added", 12, 3), ("b", "added", 5, 1), ("c", "added", 1, 1)]
    # back to what was passed on, gone, and changed
    observe(spark, feed, [("a", 9.0, 99, 111.0), ("a", 3.0, 12, 112.0), ("b", None, None, 111.0), ("c", 2.0, 2, 111.5), ("d", 1.0, 1, 130.0)])
    run()
    # c's observations of 110 and 111.5 are one burst, which both runs have seen a part of
    assert settled_rows(spark, out) == [("a", "added", 12, 3), ("a", "same", 12, 2), ("b", "added", 5, 1), ("b", "deleted", None, 1), ("c", "added", 1, 1), ("c", "modified", 2, 2)]


def test_a_burst_is_one_refresh_and_failures_come_again(vault, spark, tmp_path, monkeypatch):
    root, feed = tmp_path / "notes", str(tmp_path / "feed")
    asked, before = [], vault.reindex
    down = [True]

    def reindex(paths=None, verify=False):
        asked.append(sorted(r.path for r in paths.collect()))
        if down:
            down.pop()
            raise OSError("the store is away")
        return before(paths, verify)

    monkeypatch.setattr(vault, "reindex", reindex)
    write(root, {"d0/new.md": "# New\n", "d1/n1.md": "# N1\nother\n"})
    (root / "d2/n2.md").unlink()
    assert settle.sweep(vault, feed) == 3
    # what lay below a folder that is a file now can't be told to be absent
    spark.createDataFrame([("d0/n0.md/below.md", None, None)], "path string, mtime double, size long").selectExpr("*", "now() seen_at").write.mode("append").parquet(feed)
    query = settle.watch_settled(vault, feed, str(tmp_path / "watch"), quiet_ms=1000, every="1 second")
    try:
        end = time.time() + 120
        while time.time() < end and not vault.documents.filter("path = 'd2/n2.md'").isEmpty():
            time.sleep(1)  # what can't be told comes again and again, so the stream is never through
    finally:
        query.stop()
    assert asked[0] == asked[1] == ["d0/new.md", "d1/n1.md", "d2/n2.md"]
    assert {r.path for r in vault.documents.collect()} == {"d0/new.md", "d1/n1.md"} | {p for p in texts(6) if p not in ("d2/n2.md",)}
    assert {r.path for r in spark.read.parquet(str(tmp_path / "watch/retries")).collect()} >= {"d0/n0.md/below.md", "d1/n1.md"}
    assert plan.RETRIES == 3


# --- git lineage ----------------------------------------------------------------------------


@pytest.fixture
def repository(tmp_path):
    import subprocess

    root = tmp_path / "repo"
    root.mkdir()
    at = [1_600_000_000]

    def git(*a):
        at[0] += 60
        env = os.environ | {"GIT_AUTHOR_DATE": f"{at[0]} +0000", "GIT_COMMITTER_DATE": f"{at[0]} +0000", "GIT_CONFIG_GLOBAL": "/dev/null"}
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True, env=env).stdout.strip()

    def commit(subject, files):
        for name, text in files.items():
            if text is None:
                git("rm", "-q", name)
            else:
                write(root, {name: text})
                git("add", name)
        git("commit", "-q", "-m", subject)
        return git("rev-parse", "HEAD")

    git("init", "-q", "-b", "main")
    return root, git, commit


LONG = "".join(f"line {k} of a note\n" for k in range(20))


def test_history_of_a_name_that_was_used_before(spark, repository):
    root, git, commit = repository
    commit("old1", {"a.md": LONG})
    git("mv", "a.md", "b.md")
    git("commit", "-q", "-m", "moved away")
    new = commit("new1", {"a.md": "another note altogether\n" * 9})
    commit("new2", {"a.md": "another note altogether\n" * 9 + "more\n"})
    subjects = lambda p: [r.subject for r in source.git_log(spark, str(root), path=p).collect()]
    assert subjects("a.md") == ["new2", "new1"] and subjects("b.md") == ["moved away", "old1"]
    assert source.lineage(str(root), "a.md") == [] and source.lineage(str(root), "b.md") == ["a.md"]
    first = git("rev-list", "--max-parents=0", "HEAD")
    assert source.git_show(str(root), "a.md", first) is None  # another note had the name then
    assert source.git_show(str(root), "b.md", first) == LONG.encode()
    assert source.git_show(str(root), "a.md", new).startswith(b"another") and source.git_show(str(root), "a.md", "nothing") is None
    assert source.committed_revision(str(root), "b.md") == git("rev-parse", "HEAD~2")
    write(root, {"b.md": "edited"})
    assert source.committed_revision(str(root), "b.md") is None and source.committed_revision(str(root), "none.md") is None


def test_history_after_a_delete_and_a_chain_of_renames(spark, repository):
    root, git, commit = repository
    commit("first", {"n.md": LONG})
    commit("removed", {"n.md": None})
    commit("second", {"n.md": "quite other words\n" * 12})
    subjects = lambda p: [r.subject for r in source.git_log(spark, str(root), path=p).collect()]
    assert subjects("n.md") == ["second"]
    for k in range(20):
        git("mv", "n.md" if not k else f"m{k - 1}.md", f"m{k}.md")
        git("commit", "-q", "-m", f"move {k}")
    assert len(subjects("m19.md")) == source.MOST_NAMES and len(source.lineage(str(root), "m19.md")) == source.MOST_NAMES - 1
    git("checkout", "-q", "-b", "side", "HEAD~3")
    commit("aside", {"s.md": LONG})
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "merged", "side")
    assert subjects("s.md") == ["aside"]


def test_the_log_is_read_in_parts(spark, repository, monkeypatch):
    root, git, commit = repository
    assert source.git_log(spark, str(root)).count() == 0
    for k in range(7):
        commit(f"c{k}", {f"n{k % 3}.md": f"text {k}\n", f"é {k}.md": "x"})
    git("commit", "-q", "--allow-empty", "-m", "empty")
    monkeypatch.setattr(source, "LOG_PART", 3)
    rows = sorted(source.git_log(spark, str(root)).collect(), key=lambda r: -r.committed_at)
    assert [r.subject for r in rows] == ["empty", *(f"c{k}" for k in range(6, -1, -1))]
    assert rows[0].paths == [] and rows[1].paths == ["n0.md", "é 6.md"]
    assert source.git_log(spark, str(root), limit=4).count() == 4


# --- names --------------------------------------------------------------------------------


def test_near_names_by_index_equal_a_scan(vault, spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "alpah", "alpa", "beta", "betta", "bet", "abc", "abd", "xabc", "ab", "n1", "a" * 64, "b" * 65]
    own = [("/".join(rng.choice(words) + rng.choice(["", "-", " ", "_x"]) + rng.choice(words) for _ in range(rng.randint(1, 3))) + ".md",) for _ in range(120)]
    documents = spark.createDataFrame(sorted(set(own)), "path string").withColumn("path_folded", F.lower("path")).cache()
    index = population.name_index(documents).cache()
    for query in ("alpha", "ALPHX beta", "abc abd", "ab", "", "beta beta bett", "xabc", "a" * 63, "none at all"):
        scanned = population.path_search(documents, query, limit=1000).collect()
        assert population.path_search(documents, query, limit=1000, index=index).collect() == scanned, query
    plan = population.near_names(index, "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    write(tmp_path / "notes", {"d9/zebra.md": "# Z\n"})
    (tmp_path / "notes/d0/n0.md").unlink()
    vault.reindex()
    assert [r.path for r in vault.search_paths("zebrx").collect()] == ["d9/zebra.md"]
    kept = sorted(map(tuple, vault.table("names").collect()))
    assert kept == sorted(map(tuple, population.name_index(vault.documents).collect()))


def test_settling_asks_for_a_keys_state_once_whatever_its_bursts():
    from pyspark.sql import Row

    from notelake.streaming import settle

    calls = []

    class State:
        value = None

        def __init__(self, name):
            self.name = name

        def exists(self):
            calls.append((self.name, "exists"))
            return self.value is not None

        def get(self):
            calls.append((self.name, "get"))
            return self.value

        def update(self, value):
            calls.append((self.name, "update"))
            self.value = value

        def clear(self):
            calls.append((self.name, "clear"))
            self.value = None

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State(name)

        def registerTimer(self, at):  # noqa: N802
            calls.append(("timer", "set"))

        def deleteTimer(self, at):  # noqa: N802
            calls.append(("timer", "delete"))

    processor = settle.Settle(10, True)
    processor.init(Handle())
    sizes = [1, 1, 2, None, None, 3] * 20
    rows = [Row(mtime=None if n is None else 1.0, size=n, seen_at=k, seen_ms=100 * k) for k, n in enumerate(sizes)]
    found = [r.change for r in processor.handleInputRows(("a",), iter(rows[::-1]), None)] + [r.change for r in processor.handleExpiredTimer(("a",), None, None)]
    assert found == ["added", "same", "modified", "deleted", "deleted", "added"] + ["modified", "same", "modified", "deleted", "deleted", "added"] * 19
    assert len(calls) <= 9  # before: some 400
