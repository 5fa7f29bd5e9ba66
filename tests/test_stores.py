"""Vector stores read in ranges of rows by tasks."""

import json
import sqlite3

import numpy as np
import pytest

from notelake.sources import vault as source


@pytest.fixture
def saved(tmp_path, monkeypatch):
    monkeypatch.setattr(source, "STORE_PART", 7)
    values = np.random.default_rng(1).normal(size=(25, 3)).astype("f4")
    np.save(tmp_path / "v.m3.npy", values)
    rows = [{"path": f"n{k // 2}.md", "ordinal": k % 2, "folder": "", "heading": "x"} for k in range(25)]
    commit = {"format_version": 2, "index_metadata": {"provider": "p", "model": "m", "dimension": 3, "matrix": "v.m3.npy"}, "rows": rows, "tokens": {}}
    (tmp_path / "v.json").write_text(json.dumps(commit))
    (tmp_path / "list.json").write_text(json.dumps(rows))
    return tmp_path, values, rows


def same(df, values, rows):
    found = {(r.path, r.ordinal): r.embedding for r in df.collect()}
    assert len(found) == len(rows)
    return all(np.array_equal(np.array(found[r["path"], r["ordinal"]], "f4"), v) for r, v in zip(rows, values, strict=True))


def test_numpy_store_by_commit_file_and_by_list(spark, saved):
    folder, values, rows = saved
    own = source.import_numpy(spark, None, str(folder / "v.json"), {"provider": "p", "model": "m"})
    assert same(own, values, rows) and same(source.import_numpy(spark, str(folder / "v.m3.npy"), str(folder / "list.json")), values, rows)


def test_numpy_store_that_does_not_fit(spark, saved):
    folder, values, rows = saved
    with pytest.raises(ValueError, match="another way.*model"):
        source.import_numpy(spark, None, str(folder / "v.json"), {"provider": "p", "model": "other"})
    (folder / "short.json").write_text(json.dumps(rows[:-1]))
    with pytest.raises(ValueError, match="length"):
        source.import_numpy(spark, str(folder / "v.m3.npy"), str(folder / "short.json"))
    with pytest.raises(ValueError, match="names no matrix"):
        source.import_numpy(spark, None, str(folder / "list.json"))
    np.save(folder / "turned.npy", np.asfortranarray(values))
    with pytest.raises(ValueError, match="rows of"):
        source.import_numpy(spark, str(folder / "turned.npy"), str(folder / "list.json"))


def test_sqlite_store_in_ranges(spark, saved):
    folder, values, rows = saved
    with sqlite3.connect(folder / "v.db") as db:
        db.execute("CREATE TABLE chunks(id INTEGER PRIMARY KEY, path TEXT, ordinal INTEGER, folder TEXT, vector BLOB)")
        db.execute("CREATE TABLE empty(path, ordinal, folder, vector)")
        for k, (row, v) in enumerate(zip(rows, values, strict=True)):
            db.execute("INSERT INTO chunks VALUES (?, ?, ?, ?, ?)", (k * 3 + 5, row["path"], row["ordinal"], "", v.tobytes()))
    assert same(source.import_sqlite(spark, str(folder / "v.db"), dimension=3), values, rows)
    assert source.import_sqlite(spark, str(folder / "v.db"), "empty").count() == 0
    with pytest.raises(ValueError, match="dimension"):
        source.import_sqlite(spark, str(folder / "v.db"), dimension=4)
