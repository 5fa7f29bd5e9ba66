"""The pipeline against plain Python, stage by stage, on a small planted corpus."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notelake.llm import packing
from tests.conftest import SF
from tests.llm.test_index_ops import brute_components, word_sets
from tests.llm.test_text_ops import lower, slow_spans


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and reread as the pipeline does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    text = docs.orderBy("doc_id").first().text
    planted = [(top + 1, text, "en"), (top + 2, text.upper() if text.isascii() else text, "en"), (top + 3, "12345 !!", None), (top + 4, None, None), (top + 5, text + " extra", "en"), (top + 6, "the key is password = hunter2secret and that was of the", "en")]
    extra = spark.createDataFrame([(i, t, lang, "planted", len(t or "")) for i, t, lang in planted], docs.schema)
    folder = tmp_path_factory.mktemp("pipeline")
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out, top


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    out, _ = stages
    assert all(df.columns == out[0].columns for df in out[1:-1])


def test_language_stage_drops_only_what_has_none(stages):
    out, top = stages
    gone = texts(out[0]).keys() - texts(out[1]).keys()
    assert {top + 3, top + 4} <= gone
    assert all(not any(c.isalpha() for c in texts(out[0])[i] or "") for i in gone)


def test_exact_stage(stages):
    out, _ = stages
    keep = {}
    for i, t in texts(out[1]).items():
        keep[lower(t)] = max(i, keep.get(lower(t), i))
    assert texts(out[2]).keys() == set(keep.values())


def test_near_stage(stages):
    out, _ = stages
    before = texts(out[2])
    roots = brute_components(word_sets(before, 5), 80)
    assert texts(out[3]).keys() == {i for i, r in roots.items() if i == r}


def test_secrets_stage(stages):
    out, top = stages
    before, after = texts(out[3]), texts(out[4])
    assert before.keys() == after.keys()
    assert after[top + 6] == "the key is [secret] and that was of the"
    assert not any(slow_spans(t) for t in after.values())
    assert all(before[i] == t for i, t in after.items() if "[secret]" not in (t or ""))
    assert all(r.n_chars == len(r.text or "") for r in out[4].collect())


def test_packing_stage(stages):
    out, _ = stages
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(encoder.whole([t or ""])[0]) // 4 + 1 for i, t in texts(out[4]).items()}
    found = {}
    for r in out[5].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == sizes


def test_odd_documents_pass_every_stage(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, ties, and columns that could clash; then no rows at all."""
    words = "the of and was word here there with some more text about things and places".split()
    text = " ".join(words * 4)
    long = " ".join(f"{w}{k}" for k in range(4000) for w in words[:6])
    rows = [(None, text + " one", "en"), (1, None, "en"), (2, "", None), (3, text, "en"), (3, text, "en"), (3, long, "en"), (4, text.upper(), None), (5, long + " end", "de"), (6, "token=abcdef123 the word was here", "en"), (None, "password: abc12345 and more of the text", "fr")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("lang_pred", "lang_score", "_secrets", "_key", "kept", "id", "component", "sha")})
    for name, start in (("odd", docs), ("none", docs.limit(0))):
        out = [start]
        for stage, run in corpus_pipeline.STAGES:
            run(spark, out[-1], SF).write.parquet(f"{tmp_path}/{name}/{stage}")
            out.append(spark.read.parquet(f"{tmp_path}/{name}/{stage}"))
            assert stage == "packing" or out[-1].columns == docs.columns
        if name == "none":
            assert out[-1].count() == 0
            continue
        kept = [r.doc_id for r in out[2].collect()]
        assert sorted(kept, key=str) == sorted([3, 4, 5, 6, None, None], key=str)  # of text 3 and 4 the larger id stays, in any case
        redacted = {r.text for r in out[4].collect()}
        assert "[secret] the word was here" in redacted and "[secret] and more of the text" in redacted
        assert all(r.n_chars == len(r.text) and r.lang_pred == "lang_pred" for r in out[4].collect())
        assert {r.doc_id for r in out[5].collect()} == {r.doc_id for r in out[4].collect()}


def test_run(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
