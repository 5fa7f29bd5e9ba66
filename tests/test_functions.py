"""Parsing, matching and derivation in plain Python."""

import fnmatch
import re
import sqlite3
from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from notelake.functions import fts_query as Q
from notelake.functions import markdown as M
from notelake.functions import okf, patterns
from notelake.functions import text as T
from notelake.model import DocumentFilter, InvalidRequest, check_page, parse_instant

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def test_front_matter_forms():
    assert M.split_front_matter("﻿---\ntitle: a\n---\nbody") == ({"title": "a"}, "body")
    assert M.split_front_matter('+++\nx = 1\n+++\nbody') == ({"x": 1}, "body")
    assert M.split_front_matter('{"x": 2}\n\nbody') == ({"x": 2}, "body")
    assert M.split_front_matter("--- not a block") == ({}, "--- not a block")
    with pytest.raises(M.FrontMatterError):
        M.split_front_matter("---\na: [\n---\n")


def test_scalars_are_distinct_strings():
    assert M.scalars([True, "a", "a", {"x": 1}, None, 3]) == ["True", "a", "3"]


def test_headings_skip_fences():
    body = "# A\n```\n# no\n```\n## B\n~~~\n# no\n~~~~\n### C"
    assert [(lv, t) for lv, t, _ in M.headings(body)] == [(1, "A"), (2, "B"), (3, "C")]


def test_short_documents_stay_whole():
    assert len(M.HeadingChunker().chunk("# A\n\n# B\n")) == 1


def test_chunks_at_headings_with_preamble():
    body = "intro\n# A\none\n## B\ntwo\n### C\nthree\n" + "\n" * 30
    found = M.HeadingChunker().chunk(body)
    assert [(c.heading, c.heading_level, c.start_line) for c in found] == [(None, 0, 0), ("A", 1, 1), ("B", 2, 3)]


@given(st.lists(st.text("ab \n#", max_size=40), max_size=30))
def test_budget_holds_and_loses_no_word(parts):
    body = "\n".join(parts)
    found = M.HeadingChunker(short_lines=3, max_words=5).chunk(body)
    assert all(len(c.content.split()) <= 5 for c in found)
    kept = {w for c in found for w in c.content.split()} | {w for _, t, _ in M.headings(body) for w in t.split()}
    assert {w for w in body.split() if "#" not in w} <= kept


def test_outline_and_section():
    body = "# T\na\n## B\nb\n### C\nc\n## D\n"
    assert M.outline("T", [(lv, t) for lv, t, _ in M.headings(body)], 2) == [(1, "T"), (2, "B"), (2, "D")]
    assert M.section(body, "B") == "## B\nb\n### C\nc\n"
    assert M.section(body, "b") is None


@pytest.mark.parametrize(
    ("text", "targets"),
    [
        ("[a](b.md)", ["f/b.md"]),
        ("[a](/b)", ["b.md"]),
        ("[a](../../x.md#h)", ["x.md"]),
        ("[a](<b c.md>) [d](b%20c.md)", ["f/b c.md", "f/b c.md"]),
        ("![a](b.md) `[a](b.md)` [e](https://x.y/z.md) [f](#h) [p](p.png)", []),
        ("[[N]] [[M|m]] [[P#h]]", ["N.md", "M.md", "P.md"]),
        ("[a][r]\n\n[r]: t.md", ["f/t.md"]),
        ("[r][] [r]\n\n[R]: t.md 'x'", ["f/t.md", "f/t.md"]),
        ("[a](x%2Fy.md)", []),
        ("[a\n\nb](c.md)", []),
    ],
)
def test_links(text, targets):
    assert [x.target for x in M.links(text, "f/n.md")] == targets


def test_rewrite_keeps_spelling():
    body = "[a](b.md#h) [r](/f/b) [[b]] [[f/b]]"
    moved = {"f/b.md": "g/new.md"}
    assert M.rewrite_links(body, "f/n.md", moved) == "[a](../g/new.md#h) [r](/g/new) [[b]] [[g/new]]"


def test_citations():
    meta = {"sources": [{"id": "a", "resource": "R1"}, {"id": "b", "resource": "R2"}, {"id": "b", "resource": "R3"}, "bad"]}
    found = M.citations(meta, "x[^a] y[^a] z[^b] `[^a]` [^c]\n\n[^a]: note")
    assert found[3:] == [("a", "matched", 2, "R1"), ("b", "ambiguous", 1, ""), ("c", "unmatched", 1, "")]


def test_wikilinks_to_markdown():
    assert M.wikilinks_to_markdown("[[A|x]] [[B]]", "f/n.md", {"A.md": "g/A.md"}) == ("[x](../g/A.md) [[B]]", 1, 1)


def test_normal_match_maps_back():
    text = "He said “hello —  world” twice"
    (a, b), = T.find_normal(text, '"hello - world"')
    assert text[a:b] == "“hello —  world”"
    assert T.closest("alpha\nbeta\n", "alphq\nbeta")["line"] == 1
    assert T.closest("x", "completely other") is None


def test_snippet_prefers_the_left_of_equals():
    assert T.snippet("a b x c d x e", {"x"}, 3) == "a b x …"
    assert T.snippet("a b c", set(), 0) == "a b c"


def test_a_token_is_stemmed_once(monkeypatch):
    own, asked = T.stem, []
    monkeypatch.setattr(T, "stem", lambda w: (asked.append(w), own(w))[1])
    known = T.Stems()
    assert T.terms("Running runs, running\u00e9 " * 50, known) == ["run", "run", "running"] * 50 == T.terms("Running runs running\u00e9 " * 50, known)
    assert len(asked) == 3
    monkeypatch.setattr(T, "MOST_KNOWN", 2)
    text = "cats dogs mice running cats"
    assert T.terms(text) == ["cat", "dog", "mice", "run", "cat"] and T.count_words(text) == 5


def test_pieces_are_counted_once(monkeypatch):
    """Neighbours join while they fit, as before, but a section isn't counted anew for each."""
    counted = []
    own = M.HeadingChunker._size
    monkeypatch.setattr(M.HeadingChunker, "_size", lambda self, text: (counted.append(len(text)), own(self, text))[1])
    body = "\n".join("one two three" for _ in range(400)) + "\n"
    found = [c.content for c in M.HeadingChunker(max_words=300).chunk(body)]
    assert [len(c.split()) for c in found] == [300, 300, 300, 300] and "".join(found) == body
    assert sum(counted) < 4 * len(body)


def test_stems_match_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll Café Über naïve 2024 snake_case don't generalizations oscillators archaeology geologi yellow sayings by crying".split()
    for n, w in enumerate(words):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (n, w))
    stored = {}
    for term, doc, _, at in db.execute("SELECT * FROM v"):
        stored.setdefault(doc, {})[at] = term
    for n, w in enumerate(words):
        assert T.terms(w) == [stored[n][k] for k in sorted(stored[n])], w


@given(st.text("ab/.*?[]^!", max_size=12), st.text("ab/.", max_size=8))
def test_glob_agrees_with_fnmatch(pattern, path):
    if "[" in pattern:
        return
    java = patterns.fnmatch_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.match(java, path)) == fnmatch.fnmatchcase(path, pattern)


def test_query_trees():
    cols = ("title", "content")
    assert Q.parse("a b OR c NOT d", cols) == Q.Combine("OR", Q.Combine("AND", Q.Phrase("a"), Q.Phrase("b")), Q.Combine("NOT", Q.Phrase("c"), Q.Phrase("d")))
    assert Q.parse('title:"x y"*', cols) == Q.Phrase("x y", prefix=True, columns=("title",))
    assert Q.parse("-title: x", cols, ("title",)) == Q.Phrase("x", columns=())
    assert Q.parse("NEAR(a b, 3)", cols).distance == 3
    assert Q.parse("  ", cols) is None
    for bad in ('"open', "a AND", "(a", "nope: x", "a-b", "NEAR(a, x)"):
        with pytest.raises(Q.QuerySyntaxError):
            Q.parse(bad, cols)
    # strings without a token take no part in an implicit AND
    assert Q.parse_lenient("a-b (", cols) == Q.Phrase("a-b")
    assert Q.parse_lenient('( "', cols) is None


def test_scope_cannot_be_widened():
    tree = Q.parse("{title content}: x OR y", ("title", "content"), ("content",))
    assert {p.columns for p in Q.phrases(tree)} == {("content",)}


def test_requests():
    assert parse_instant("2024-01-01T00:00:00Z") == 1704067200
    for bad in ("2024-01-01", "2024-01-01T00:00:00", "2024-01-01T00:00:00+01:99"):
        with pytest.raises(InvalidRequest):
            parse_instant(bad)
    with pytest.raises(InvalidRequest):
        DocumentFilter(tags=(("x", "y"),), indexed_keys=frozenset({"tags"}))
    with pytest.raises(InvalidRequest):
        DocumentFilter(query="a\0")
    assert check_page(1, 10**30)[1] < 2**31
    with pytest.raises(InvalidRequest):
        check_page(0, 0)


def test_okf():
    assert not okf.is_stale({"stale_after": "2024-05-02"}, NOW) and okf.is_stale({"stale_after": "2024-05-01"}, NOW)
    assert okf.is_stale({"stale_after": "2024-05-01T11:59:00Z"}, NOW) and not okf.is_stale({"stale_after": "2024-05-01T11:59:00"}, NOW)
    ok = {"by": "human:ann", "at": "2024-01-01T00:00:00Z"}
    assert okf.trust_tier({"verified": [ok]}) == okf.HUMAN
    assert okf.trust_tier({"verified": ok | {"by": "tool/1"}}) == okf.MACHINE
    assert okf.trust_tier({"verified": [ok | {"at": "2024-01-01"}, ok | {"by": "ann"}]}) == okf.UNVERIFIED
    a = okf.annotate({"status": " deprecated ", "sources": [{"resource": 1}, 2], "verified": []}, NOW)
    assert (a["status"], a["attribution"]["recorded_entries"], a["review"]["state"]) == ("deprecated", 1, "empty")
    assert okf.matches(a, {"stale": "no", "status": "deprecated"}) and not okf.matches(a, {"stale": "yes"})
    with pytest.raises(ValueError):
        okf.parse_stale("maybe")
    assert okf.findings("a.md", {"status": "odd", "okf_version": 1}, "[[x]]") == ["missing_type", "misplaced_okf_version", "unknown_status", "wikilink_files", "missing_recommended", "missing_freshness"]
    full = {"type": "t", "title": "x", "description": "d", "stale_after": "soon", "sources": [1], "generated": {}, "verified": {"by": "x"}}
    assert okf.findings("a.md", full, "") == ["malformed_sources", "malformed_generated", "malformed_freshness", "malformed_review"]
    assert okf.findings("a.md", full, "x" * 70000) == ["evidence_unavailable"]
    assert okf.findings("a.md", None, "") == ["unparseable_frontmatter", "evidence_unavailable"]
    assert okf.findings("log.md", {}, "## today\n", False) == ["log_heading_shape"]
    assert okf.findings("index.md", {"okf_version": 1}, "") == [] and okf.findings("f/index.md", {}, "") == ["index_frontmatter"]


def test_brackets_pair_with_the_nearest_opening():
    def found(text):
        return [(x.target, x.kind, x.text) for x in M.links(text, "d/n.md")]

    assert found("[bbb](b.md) then [a](a.md) then [rr][x] and [[W]]\n\n[x]: c.md\n") == [("d/b.md", "markdown", "bbb"), ("d/a.md", "markdown", "a"), ("d/c.md", "reference", "rr"), ("W.md", "wikilink", "W")]
    assert found("[a [b](y.md) c](x.md)") == [("d/y.md", "markdown", "b")]
    assert found("![i [k](z.md)](p.png) [open [k](z.md)") == [("d/z.md", "markdown", "k")] * 2
    assert found("[ar][a] [x][] [x] [q][[]\n\n[x]: d.md\n[q]: e.md\n") == [("d/d.md", "reference", "x")] * 2 + [("d/e.md", "reference", "q")]
    assert found("[a](x.md) [a]\n\n[a]: y.md\n") == [("d/x.md", "markdown", "a"), ("d/y.md", "reference", "a")]
    assert found("[^s]\n\n[^s]: n.md\n") == []


def test_brackets_take_linear_time():
    assert M.links("[" * 50_000, "n.md") == [] and M.links("[ar][" * 20_000, "n.md") == []


def test_chunks_follow_the_outline_only_one_level_down():
    cut = M.HeadingChunker(short_lines=0, max_words=4)
    body = "# A\none two\n#### Deep\nthree four five\n## B\npre\n### C\nw w w w w w\n"
    found = [(c.heading, c.heading_level, c.content, c.start_line) for c in cut.chunk(body)]
    # A has no heading of level 2 below it, so its lines are packed; B has one of level 3
    assert found == [("A", 1, "one two\n#### Deep\n", 0), ("A", 1, "three four five\n", 2), ("B", 2, "pre\n", 5), ("C", 3, "w w w w", 6), ("C", 3, "w w", 6)]


def test_edits_match_within_lines_only():
    text = "a  b \nc \u201cd\u201d\n"
    assert T.find_normal(text, "a b\nc") == [(0, 7)]
    assert T.find_normal(text, "a b c") == [] and T.find_normal(text, 'c "d"') == [(6, 11)]


def test_citation_inspection():
    report = M.inspect_citations("---\nsources: [{id: a, resource: r}, {id: a}, {resource: q}, 3, {id: 7}]\n---\nx[^a] y[^b]\r\n")
    assert [(c["id"], c["status"], c["source_indices"]) for c in report["citations"]] == [("a", "ambiguous", [0, 1]), ("b", "unmatched", [])]
    assert report["duplicate_ids"] == ["a"] and report["unkeyed_source_indices"] == [2]
    assert report["source_issues"] == ["sources[3] is not a mapping", "sources[4].id is not a nonempty string"]
