"""Long notes, and bounds of what a task holds."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from notelake.functions import markdown as M
from notelake.functions.fts_query import parse
from notelake.operators import fulltext
from notelake.sources import vault as source
from tests.conftest import SF, same_rows


@pytest.fixture(scope="module")
def long_notes(spark, tmp_path_factory):
    """The smallest tables, with texts over the audited length among the documents."""
    root = tmp_path_factory.mktemp("long")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.selectExpr("doc_id", "case when doc_id % 50 = 3 then repeat(text || ' the and\n', 70000 div (length(text) + 9) + 1) else text end as text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    return str(root)


def expected(name: str, root: str):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet/*.parquet')")
    for table in ("labels", "customer", "supplier", "nation", "region", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return db.execute(entry.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", ["okf_audit"])
def test_long_notes_as_in_sql(spark, long_notes, name):
    assert same_rows(entry.queries()[name](spark, long_notes).toPandas(), expected(name, long_notes))


class NoChunker:
    def chunk(self, content, metadata):
        raise ValueError("nobody asked for sections")


def test_only_asked_columns_are_parsed(spark):
    """A table's query pays for that table alone; its rows are those of the whole parse."""
    text = "---\ntags: [a, b]\nsources: [{id: s, resource: R}]\n---\n# H\nSee [n](n.md)[^s]\n"
    files = spark.createDataFrame([(f"d/{k}.md", 1.0, text.encode()) for k in range(3)] + [("bad.md", 1.0, b"\xff")], "path string, mtime double, content binary")
    whole = source.tables(source.parse(files))
    for name in ("headings", "tags", "citations", "links", "okf"):
        alone = source.tables(source.parse(files, source.ParseOptions(chunker=NoChunker()), (name,)))
        assert list(alone) == [name] and sorted(map(str, alone[name].collect())) == sorted(map(str, whole[name].collect())) != []
    assert source.parse(files, columns=("okf",)).columns == ["path", "skip_category", "okf"]


def test_parsed_batches_are_bounded(spark):
    """Notes of 10 MB in one batch go on in slices of SLICE_BYTES, not at once."""

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pylist([{"path": f"n{k}.md", "mtime": 1.0, "content": b"word " * 20_000} for k in range(100)])
    found = [b.num_rows for b in source.parse(Files(), source.ParseOptions(max_chunk_words=None), ("sections",))(iter([batch]))]
    assert sum(found) == 100 and max(found) <= source.SLICE_BYTES // 100_000


def test_links_are_only_sought_where_brackets_are(monkeypatch):
    """Paragraphs without a bracket are read over; fences are only sought where there are any."""
    seen = []
    before = M._innermost
    monkeypatch.setattr(M, "_innermost", lambda part, target: (seen.append(part), before(part, target))[1])
    text = "plain\n\n" * 50 + "See [a](b.md)\n\n" + "plain\n\n" * 50
    assert [x.target for x in M.links(text, "n.md")] == ["b.md"]
    assert len(seen) == 2 and set(seen) == {"See [a](b.md)"}


def test_keyword_query_reads_the_text_once(spark):
    """All words of a query come of one pass, also those after NOT, and only their postings are made."""
    d = entry.queries()["bm25_not"](spark, SF)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1
    rows = spark.createDataFrame([("a.md", 0, "One two three two"), ("b.md", 0, None), ("c.md", 1, "twofold TWO")], "path string, ordinal int, content string")
    whole = fulltext.build_postings(rows, ("content",), stemmed=False)[0]
    asked = fulltext.Asked.by(parse('two NOT (thr* OR "one two")', ("content",)), lambda text: text.split())
    assert asked == fulltext.Asked(frozenset({"two", "one"}), frozenset({"thr"}))
    own = fulltext.build_postings(rows, ("content",), stemmed=False, asked=asked)[0]
    assert sorted(map(str, own.collect())) == sorted(map(str, whole.filter("term in ('one', 'two', 'three')").collect())) != []


def test_text_is_cut_into_tokens_by_slices():
    batch = pa.RecordBatch.from_pydict({"content": ["x" * 400_000] * 10 + ["y" * 3_000_000, None, ""]})
    found = [b.num_rows for b in fulltext._slices(iter([batch]), ("content",))]
    assert sum(found) == 13 and max(found[:5]) == 2 and len(found) == 7


def test_postings_of_a_slice_go_on_by_term():
    """A store sorts postings by term; runs that are in order already are only merged."""

    class Rows:
        columns = ["path", "ordinal", "content", "title"]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pylist([{"path": f"n{k}.md", "ordinal": k, "content": "pear fig apple fig", "title": "zoo and ant"} for k in range(3)])
    found = [b.column("term").to_pylist() for b in fulltext.build_postings(Rows(), ("content", "title"))[0](iter([batch]))]
    assert [len(terms) for terms in found] == [18] and found[0] == sorted(found[0])
