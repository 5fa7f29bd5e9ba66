"""The command line over a small vault."""

import io
import json

from notelake.__main__ import main


def test_commands(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    (root / "a.md").write_text("---\ntags: x\n---\n# A\nfoxes [b](b.md)\n")
    (root / "b.md").write_text("# B\ndogs\n")

    def run(*args):
        out = io.StringIO()
        main(["--root", str(root), "--store", str(tmp_path / "s"), *args], spark, out)
        return [json.loads(line) for line in out.getvalue().splitlines()]

    assert run("build") == [{"generation": 1}]
    assert run("count", "--tag", "tags=x") == [{"total": 1}]
    assert [r["path"] for r in run("search", "fox", "--mode", "keyword")] == ["a.md"]
    assert [r["source_path"] for r in run("backlinks", "--path", "b.md")] == ["a.md"]
    assert run("connect", "--path", "b.md", "--to", "a.md") == [{"path": ["b.md", "a.md"]}]
    assert run("aggregate", "--by", "tag", "--key", "tags")[0]["key"] is None
    assert run("toc", "--path", "b.md") == [{"level": 1, "heading": "B"}]
