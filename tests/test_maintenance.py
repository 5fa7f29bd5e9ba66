"""Upkeep: detection, stamps, generated pages, jobs."""

import time

import pytest

from notelake.operators import vector
from notelake.plans import maintenance as X
from notelake.plans.vault import Vault


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "v"
    (root / "a/b").mkdir(parents=True)
    (root / "index.md").write_text("---\nokf_version: 1\n---\n# Home\n")
    (root / "a/one.md").write_text("# One\n[[Two]] [[None]]\n")
    (root / "a/b/Two.md").write_text("# Two\n")
    (root / "log.md").write_text("# Log\n\n## 2024-01-01\n\n- x\n\n## 2024-01-02\n\n- y\n\n## 2024-01-01\n\n- x\n- z\n")
    v = Vault(spark, str(root), str(tmp_path / "s"), embed=lambda t: [vector.hash_embedding(x, 8) for x in t])
    v.build()
    return v


def test_upkeep(vault):
    assert X.detect(vault) and X.detect(vault, "on") and not X.detect(vault, "off")
    X.stamp(vault, "a/one.md", "tool/1")
    X.verify(vault, "a/one.md", "human:ann")
    meta = vault.read("a/one.md")["frontmatter"]
    assert meta["generated"]["by"] == "tool/1" and meta["verified"][0]["by"] == "human:ann"
    assert X.convert_links(vault) == (1, 1) and "[Two](b/Two.md)" in vault.read("a/one.md")["text"]
    assert X.build_indexes(vault) == ["a/index.md", "a/b/index.md"]
    assert vault.read("a/index.md")["text"] == "# a\n\n- [One](one.md)\n- [b/](b/index.md)\n"
    with pytest.raises(FileExistsError):
        X.seed_log(vault)
    assert X.repair_log(vault, apply=True) == "# Log\n\n## 2024-01-02\n\n- y\n\n## 2024-01-01\n\n- x\n- z\n"
    assert vault.read("log.orig.md")
    X.append_log(vault, "new", day="2024-01-03")
    X.append_log(vault, "more", day="2024-01-03")
    assert vault.read("log.md")["text"].startswith("# Log\n\n## 2024-01-03\n\n- more\n- new\n\n## 2024-01-02")
    assert X.embedding_status(vault)["mode"] == "keyword"


def test_jobs(vault):
    jobs = X.Jobs()
    names = [jobs.start(vault, lambda: vault.documents.count()), jobs.start(vault, lambda: 1 / 0)]
    for name in names:
        jobs.known[name]["thread"].join(60)
    assert [jobs.status(n)["state"] for n in names] == ["completed", "failed"]
    slow = jobs.start(vault, lambda: time.sleep(1))
    jobs.cancel(vault, slow)
    assert jobs.status(slow)["state"] == "cancelled"
