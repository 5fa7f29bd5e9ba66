"""The snapshot store against a plain dict: directories, deltas, merges, writers that die, other settings."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.plans import snapshot
from notelake.plans.snapshot import SnapshotStore

ROW = "path string, n int, text string"


def rows(spark, values):
    return spark.createDataFrame(values, ROW)


def held(store, table="t"):
    return sorted((r.path, r.n) for r in store.read(table).collect())


def test_random_updates_equal_a_dict(spark, tmp_path):
    rng, store = random.Random(5), SnapshotStore(spark, str(tmp_path / "s"), bucket_bytes=2_500)
    state = {f"n{k}": [k] for k in range(200)}
    store.publish({"t": rows(spark, [(p, n, "x" * 200) for p, ns in state.items() for n in ns])})
    assert len(store.manifest()["tables"]["t"]["buckets"]) > 1
    for step in range(12):
        touched = rng.sample([f"n{k}" for k in range(260)], 1 if step % 3 else 40)
        fresh = {p: [step * 1000 + j for j in range(rng.randint(0, 2))] for p in touched}
        state = {p: v for p, v in state.items() if p not in fresh} | fresh
        new = rows(spark, [(p, n, str(rng.random()) * 9) for p, ns in fresh.items() for n in ns] or [("", 0, "")])
        store.upsert({"t": new if any(fresh.values()) else new.limit(0)}, spark.createDataFrame([(p,) for p in touched], "path string"))
        assert held(store) == sorted((p, n) for p, ns in state.items() for n in ns), step
    # a reader of any settings sees the same rows, and so does a store after merging
    assert held(SnapshotStore(spark, str(tmp_path / "s"), bucket_bytes=1)) == held(store)
    store.compact(least=1)
    assert not any(b["deltas"] for b in store.manifest()["tables"]["t"]["buckets"].values())
    assert held(store) == sorted((p, n) for p, ns in state.items() for n in ns)


def test_a_bucket_is_split_alone(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), bucket_bytes=20_000)
    text = F.sha2(F.col("id").cast("string"), 256)
    many = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("path"), F.col("id").cast("int").alias("n"), F.concat(text, F.reverse(text)).alias("text"))
    store.publish({"t": many})
    names = sorted(store.manifest()["tables"]["t"]["buckets"])
    assert len(names) >= 8 and sum(2.0 ** -int(n.split(".")[0]) for n in names) == 1.0
    one = store._bucket("path", names)
    assert many.select(one.alias("b")).distinct().count() == len(names)
    # each stored file lies in the bucket that the directory gives its rows
    for k, n in enumerate(names):
        own = store._open(store.manifest()["tables"]["t"], [n])
        assert own.filter(one != k).isEmpty()


def test_one_edit_writes_the_same_bytes_at_any_size(spark, tmp_path):
    grown = []
    for n in (2_000, 20_000):
        store = SnapshotStore(spark, str(tmp_path / str(n)), bucket_bytes=100_000)
        text = F.sha2(F.col("id").cast("string"), 256)
        many = spark.range(n).select(F.concat(F.lit("n"), "id").alias("path"), F.col("id").cast("int").alias("n"), text.alias("text"))
        store.publish({"t": many})
        before = store.files.bytes("data")
        store.upsert({"t": rows(spark, [("n7", -1, "new")])}, spark.createDataFrame([("n7",)], "path string"))
        grown.append(store.files.bytes("data") - before)
        assert store.read("t").filter("path = 'n7'").collect()[0].n == -1 and store.read("t").count() == n
    assert max(grown) < 10_000 and abs(grown[0] - grown[1]) < 1_000


def test_many_small_deltas_become_one(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    text = F.sha2(F.col("id").cast("string"), 256)
    store.publish({"t": spark.range(4000).select(F.concat(F.lit("n"), "id").alias("path"), F.col("id").cast("int").alias("n"), text.alias("text"))})
    most = 0
    for k in range(snapshot.MOST_DELTAS + 2):
        store.upsert({"t": rows(spark, [(f"n{k % 3}", -k, "x")])}, spark.createDataFrame([(f"n{k % 3}",)], "path string"))
        (bucket,) = store.manifest()["tables"]["t"]["buckets"].values()
        most = max(most, len(bucket["deltas"]))
    assert most == snapshot.MOST_DELTAS and 1 <= len(bucket["deltas"]) <= 2
    own = {r.path: r.n for r in store.read("t").collect()}
    assert len(own) == 4000 and {own[f"n{k}"] for k in range(3)} == {-9, -8, -7}


def test_stages_of_two_jobs_are_apart(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path / "s")), SnapshotStore(spark, str(tmp_path / "s"))
    with one.job() as keep:
        mine = keep(spark.range(5).toDF("n"))
        with two.job() as other:
            other(spark.range(3).toDF("n"))
        assert mine.count() == 5
    assert not list((tmp_path / "s" / "stage").iterdir())


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish({"t": rows(spark, [("a", 1, "")])})
    lost = rows(spark, [("b", 1, "")]).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    before = sorted(p.name for p in (tmp_path / "s/data").iterdir())
    with pytest.raises(Exception, match="lost"):
        store.publish({"t": lost})
    with pytest.raises(Exception, match="lost"):
        store.upsert({"t": lost}, spark.createDataFrame([("b",)], "path string"))
    assert sorted(p.name for p in (tmp_path / "s/data").iterdir()) == before and held(store) == [("a", 1)]


def test_tables_bring_their_own_paths(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    links = spark.createDataFrame([("a", "x"), ("b", "y")], "source_path string, target_path string")
    store.publish({"t": rows(spark, [("a", 1, ""), ("b", 2, "")]), "links": links})
    both = spark.createDataFrame([("a",), ("b",)], "path string")
    store.upsert({"t": rows(spark, [("a", 9, "")]), "links": (links.withColumn("target_path", F.upper("target_path")), both)}, both.filter("path = 'a'"))
    assert held(store) == [("a", 9), ("b", 2)]
    assert sorted(r.target_path for r in store.read("links").collect()) == ["X", "Y"]


def test_a_build_writes_its_large_tables_once_and_shuffles_neither(spark, tmp_path, monkeypatch):
    from notelake.plans.vault import Vault

    rng = random.Random(3)
    (tmp_path / "notes").mkdir()
    for n in range(60):
        (tmp_path / "notes" / f"{n}.md").write_text(f"# Note {n}\n\n" + " ".join(f"w{rng.randrange(60)}" for _ in range(700)) + f"\n\n[[{n + 1}]]\n")
    written, again = {}, []
    write, rebase = SnapshotStore._write, SnapshotStore._rebase

    def seen(self, path, df, key, names, *dealt):
        found = write(self, path, df, key, names, *dealt)
        for kind in {"term", "content"} & set(df.columns):
            rows = df.withColumn("_bucket", self._bucket(key, names))
            written[kind] = (rows if any(dealt) else rows.hint("rebalance", "_bucket"))._jdf.queryExecution().executedPlan().toString()
        return found

    monkeypatch.setattr(SnapshotStore, "_write", seen)
    monkeypatch.setattr(SnapshotStore, "_rebase", lambda self, folder, own, names: (again.append({f["name"] for f in own["schema"]["fields"]}), rebase(self, folder, own, names)))
    vaults = [Vault(spark, str(tmp_path / "notes"), str(tmp_path / s)) for s in ("one", "many")]
    vaults[1].store.bucket_bytes = 80_000
    for vault in vaults:
        vault.build()
        assert not [x for x in again if x & {"term", "content"}]
        assert len(written) == 2 and not any("Exchange" in p or "Join" in p for p in written.values())
    one, many = (v.store.manifest()["tables"] for v in vaults)
    for name in ("sections", "postings"):
        assert len(one[name]["buckets"]) == 1 and len(many[name]["buckets"]) > 2
        a, b = (v.table(name) for v in vaults)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()
    assert vaults[1].reindex() == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 60}
