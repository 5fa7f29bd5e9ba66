"""The tables of near-duplicate detection that lie in buckets."""


def test_a_join_with_a_table_in_buckets_shuffles_only_the_other_side(spark):
    from notelake.llm.near_dedup import near_duplicates
    from notelake.llm.store import materialize, release

    sets = materialize(spark.range(5000).selectExpr("id", "cast(repeat(cast(id as string), 50) as binary) AS elements"), "elements", "id")
    rows = materialize(spark.range(0, 20_000).selectExpr("id % 6000 AS id", "cast(id as string) AS grp"), "rows")
    joined = rows.hint("merge").join(sets, "id")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert joined.count() == sum(1 for n in range(20_000) if n % 6000 < 5000)
    name = sets._nl_name
    release(sets)
    assert not spark.catalog.tableExists(name)
    # the operator's sets lie so, and their names are gone when it ends
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + (f" x{i}" if i % 2 else "")) for i in range(6)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, k=3, percent=85).collect()} == dict.fromkeys(range(6), 0)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_run_of_bands_joins_the_sets_twice_at_most(spark, monkeypatch):
    """Small groups and hubs of large ones go through one join with the sets, all that is left through another."""
    from notelake.llm import near_dedup
    from tests.llm.test_index_ops import brute_components, word_sets

    joins = []
    together = near_dedup._together
    monkeypatch.setattr(near_dedup, "_together", lambda *a: joins.append(1) or together(*a))
    monkeypatch.setattr(near_dedup, "RUNS", ())
    monkeypatch.setattr(near_dedup, "LISTED", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join([*base[:i], f"x{i}", *base[i:]]) for i in range(30)}
    texts |= {100 + i: " ".join([f"y{i}" if j % 9 == 0 else w for j, w in enumerate(base)]) for i in range(10)}
    texts |= {200 + i: " ".join([*base[: 78 - i], *(f"z{i}" for _ in range(i))]) for i in range(20)}  # ever farther from the base
    texts |= {300 + i: " ".join([f"v{j}" for j in range(40)] + [f"u{i}"]) for i in range(3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=3, percent=85, bands=26).collect()} == brute_components(word_sets(texts, 3), 85)
    assert len(joins) <= 2


def test_groups_of_equal_members_are_one(spark):
    from notelake.llm.near_dedup import _spanning

    rows = [("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 3), ("d", 3), ("e", 5)]
    found = _spanning(spark.createDataFrame(rows, "grp string, id long").selectExpr("grp", "id", "1 AS weight", "id AS component")).collect()
    assert sorted((r.grp, r.id, r.size, r.hub) for r in found) == [("a", 1, 3, 1), ("a", 2, 3, 1), ("a", 2, 3, 1), ("c", 1, 3, 1), ("c", 1, 3, 1), ("c", 2, 3, 1), ("d", 1, 3, 1), ("d", 3, 3, 1), ("d", 3, 3, 1)]


def test_links_are_written_once_and_labels_jump_at_once(spark, monkeypatch):
    from notelake.llm import components

    labels = []
    written = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: labels.append(label) or written(df, label))
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    forest = components.connected_components(path)
    assert {r.component for r in forest.collect()} == {0}
    assert labels.count("labels") <= 7  # 8, when a round took the label of the label before
    labels.clear()
    more = components.grown(forest, spark.createDataFrame([(3, 100), (100, 101), (59, 101), (3, 4)], "a long, b long"))
    assert {r.node: r.component for r in more.collect()} == dict.fromkeys([*range(61), 100, 101], 0)
    assert set(labels) == {"edges", "labels", "forest"}
