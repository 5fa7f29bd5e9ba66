"""N-best lattice, web archives, near-dedup and the permutation index against brute force."""

import gzip
import io
import itertools
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import components, near_dedup, permutation_index, piece_lattice, queries, warc_zip
from tests.conftest import SF, same_rows
from tests.llm.test_text_ops import DOC, LONG, ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return piece_lattice.Lattice(MODEL)


def every_segmentation(lattice, word):
    """All segmentations of a short word: (score, ids)."""
    out = []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k in [*(i + 1 for i, c in enumerate(cuts) if c), len(word)]:
            parts.append(word[at:k])
            at = k
        if all(p in lattice.ids or len(p) == 1 for p in parts):
            score = sum(float(lattice.scores[lattice.ids[p]]) if p in lattice.ids else lattice.unknown_score for p in parts)
            out.append(score)
    return sorted(out, reverse=True)


@settings(deadline=None)
@given(word=st.text("theanrgi▁é☃", min_size=1, max_size=9))
def test_words_against_brute_force(lattice, word):
    wanted = every_segmentation(lattice, word)
    assert [round(s) for s, _ in lattice.nbest_word(word, 4)] == [round(s) for s in wanted[:4]]
    lattice.prepare([[word]])
    k = lattice.number[word]
    assert round(lattice.score[k]) == round(wanted[0])
    assert (lattice.gap[k] == np.inf) if len(wanted) == 1 else round(lattice.gap[k]) == round(wanted[0] - wanted[1])


@settings(deadline=None, max_examples=30)
@given(words=st.lists(st.text("thean", min_size=1, max_size=3), min_size=1, max_size=4))
def test_texts_against_brute_force(lattice, words):
    text = " ".join(words)
    wanted = every_segmentation(lattice, "▁" + text.replace(" ", "▁"))
    found = list(lattice.nbest(text, 4))
    assert [round(s) for s, _, _ in found] == [round(s) for s in wanted[:4]]
    assert all(same for *_, same in found) and len({ids for _, ids, _ in found}) == len(found)


@settings(deadline=None)
@given(text=st.text(max_size=40).filter(lambda t: "▁" not in t))
def test_round_trip(lattice, text):
    for _, ids, same in lattice.nbest(text, 3):
        assert same and lattice.decode(np.frombuffer(ids, dtype="<u4").tolist()) == text


def test_agrees_with_the_library(lattice):
    """The library's own N-best over the same pieces and scores, read as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    other = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for word in "internationalization thereof understanding größer déjà".split():
        wanted = [sum(lattice.scores[i] for i in ids) for ids in other.nbest_encode_as_ids(word, 5)]
        assert [s for s, _ in lattice.nbest_word("▁" + word, 5)] == wanted


def plain_nbest(lattice, word, n):
    """Scores of the n best segmentations by a plain n-best Viterbi."""
    best = [[0.0]]
    for j in range(1, len(word) + 1):
        own = []
        for k in range(1, min(j, lattice.longest) + 1):
            piece = lattice.ids.get(word[j - k : j])
            if piece is not None or k == 1:
                own += [s + (lattice.unknown_score if piece is None else float(lattice.scores[piece])) for s in best[j - k]]
        best.append(sorted(own, reverse=True)[:n])
    return best[-1]


@pytest.mark.parametrize("word", ["an" * 400, "a" * 1501, "thereisnospaceinthis" * 40 + "é☃", "aGVsbG8gd29ybGQ" * 60])
def test_long_words_without_spaces(lattice, word):
    found = lattice.nbest_word("▁" + word, 4)
    assert [round(s) for s, _ in found] == [round(s) for s in plain_nbest(lattice, "▁" + word, 4)]
    assert len({ids for _, ids in found}) == 4
    own = list(lattice.nbest(word, 4))
    assert [round(s) for s, _, _ in own] == [round(s) for s, _ in found] and all(same for *_, same in own)


def test_very_long_text_without_spaces_takes_little_memory(spark, lattice):
    import base64
    import tracemalloc

    text = base64.b64encode(np.random.default_rng(5).bytes(150_000)).decode()
    assert len(text) == 200_000
    tracemalloc.start()
    own = list(lattice.nbest(text[:50_000], 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75_000_000 and all(same for *_, same in own) and len(own) == 4
    rows = spark.createDataFrame([(1, text), (1, text), (None, "漢字" * 5000)], "doc_id long, text string").withColumn("rank", F.lit("clash"))
    assert piece_lattice.encode_nbest(rows, MODEL, n=2, digest=True).filter("round_trip and doc_id = 1").count() == 4


def test_encode_and_decode_tables(spark):
    rows = spark.createDataFrame([(1, "hello there"), (2, None), (3, ""), (None, "x\ny"), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = piece_lattice.encode_nbest(rows, MODEL, n=3)
    best = coded.filter("rank = 1")
    back = {(r.doc_id, r.text) for r in piece_lattice.decode_ids(best, MODEL).collect()}
    assert back == {(1, "hello there"), (2, ""), (3, ""), (None, "x\ny")}
    assert coded.filter("doc_id = 2").count() == 1 and coded.filter("not round_trip").isEmpty()
    assert piece_lattice.encode_nbest(rows.limit(0), MODEL).count() == 0
    query = queries.QUERIES["op1_piece_nbest"](spark, SF)
    assert query.filter("rank = 1").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert query.filter("not round_trip").isEmpty()


# --- web archives ---------------------------------------------------------------------------


def test_pages_query_matches_sql(spark, oracle):
    assert same_rows(queries.QUERIES["op2_warc_zip"](spark, SF).toPandas(), oracle(queries.ORACLE["op2_warc_zip"]))


def test_archives_of_odd_pages(spark, tmp_path):
    big = "é<p>" * 50_000
    rows = [(1, "u1", "x" * 99), (2, "u2", "x" * 99), (3, "u\r\n3", big), (7, None, big), (7, None, big), (4, "u4", None), (5, "u5", ""), (None, "u6", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    manifest = warc_zip.write_archives(pages, f"file://{tmp_path}", archive_bytes=300)
    found = warc_zip.read_archives(manifest).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == Counter([(1, "response", None), (2, "response", None), (3, "response", None), (7, "revisit", 3), (7, "revisit", 3), (4, "response", None), (5, "response", None), (None, "response", None)])
    assert {bytes(r.payload) for r in found if r.page_id == 3} == {big.encode()} and {r.payload_bytes for r in found if r.page_id == 7} == {len(big.encode())}
    some = warc_zip.read_archives(manifest, lambda e: e["page_id"] == 4).collect()
    assert [r.page_id for r in some] == [4]
    assert warc_zip.read_archives(warc_zip.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


@pytest.mark.parametrize("zip64", [True, False])
def test_directory_forms(tmp_path, zip64):
    path = tmp_path / "a.zip"
    writer = warc_zip.ArchiveWriter(f"file://{path}", zip64)
    for k in range(50):
        body = f"page {k}".encode() * 30
        writer.add(k, f"u{k}", warc_zip.build_record(k, f"u{k}", body, "d", None))
    writer.close()
    with zipfile.ZipFile(path) as z:  # other readers open it too
        assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX, warc_zip.PACKAGE]
    reader = warc_zip.ArchiveReader(f"file://{path}")
    assert [r["page_id"] for r in reader.records(most=500)] == list(range(50))
    with pytest.raises(ValueError):
        reader.read(warc_zip.DATA, 0, 10**9)


@pytest.mark.parametrize("index", ["plain", "gzip", "none"])
def test_archives_of_other_writers(tmp_path, index):
    """Several data members, gzipped and not, other record types, indexes by file name or none at all."""
    import json

    def warc(kind, body, **extra):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in extra.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    http = {"Content_Type": "application/http; msgtype=response", "WARC_Target_URI": "http://a.example/x"}
    first = [gzip.compress(warc("warcinfo", b"software: x")), gzip.compress(warc("response", b"HTTP/1.1 200 OK\r\n\r\n<p>one", **http))]
    second = [warc("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>two", **http), warc("resource", b"three" * 30_000)]
    lines = []
    for name, parts in (("a.warc.gz", first), ("b.warc", second)):
        at = 0
        for part in parts:
            lines.append(f"example,a)/x 20200101000000 " + json.dumps({"filename": name, "offset": str(at), "length": str(len(part))}) + "\n")
            at += len(part)
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(first))
        z.writestr("archive/b.warc", b"".join(second))
        if index != "none":
            data = "".join(sorted(lines)).encode()
            z.writestr("indexes/i.cdx.gz" if index == "gzip" else "indexes/i.cdxj", gzip.compress(data) if index == "gzip" else data)
    reader = warc_zip.ArchiveReader(f"file://{path}")
    found = list(reader.records())
    assert [(r["record_type"], r["payload"][:8]) for r in found] == [("warcinfo", b"software"), ("response", b"<p>one"), ("response", b"<p>two"), ("resource", b"threethr")]
    assert {r["page_id"] for r in found} == {None} and found[1]["url"] == "http://a.example/x"


def test_index_lines_and_record_ids(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://www.b.example/Q?a b", "x"), (1, "u", "x"), (None, None, "y"), (None, None, "y")], "page_id long, url string, html string")
    uri = warc_zip.write_archives(pages.coalesce(1), f"file://{tmp_path}").first().archive
    reader = warc_zip.ArchiveReader(uri)
    lines = reader.read(warc_zip.INDEX).decode().splitlines()
    assert lines == sorted(lines) and any(line.startswith("example,b)/q?a%20b 19700101000000 {") for line in lines)
    data = gzip.decompress(reader.read(warc_zip.DATA))
    ids = [x for x in data.split(b"\r\n") if x.startswith(b"WARC-Record-ID: <urn:uuid:")]
    assert len(set(ids)) == 4


def test_zip64_directory_is_used():
    """An archive whose 32-bit fields are all full, as over 4 GB or 65,535 members."""
    raw = io.BytesIO()
    limit, count = zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT
    zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = 10, 1
    try:
        with zipfile.ZipFile(raw, "w") as z:
            z.comment = b"PK\5\6 not the end"
            z.writestr("a", b"x" * 100)
            z.writestr("b", b"y" * 50)
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = limit, count
    assert b"PK\6\6" in raw.getvalue()
    reader = warc_zip.ArchiveReader(raw)
    assert reader.read("a", 90) == b"x" * 10 and reader.read("b") == b"y" * 50


@pytest.mark.parametrize("data", [b"", b"PK\5\6", b"x" * 100])
def test_damaged_archives(data):
    with pytest.raises(ValueError):
        warc_zip.ArchiveReader(io.BytesIO(data))


# --- near-dedup -----------------------------------------------------------------------------


def word_sets(texts, k):
    out = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        out[key] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    return out


def brute_components(sets, percent):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {k: root(k) for k in sets}


@pytest.mark.parametrize(("k", "percent", "bands"), [(3, 85, 26), (5, 80, 40)])  # as registered, and the defaults
def test_components_against_brute_force(spark, k, percent, bands):
    rng = np.random.default_rng(3)
    texts, words = {}, [f"w{i}" for i in range(300)]
    for group in range(12):  # chains of edits, so that components reach beyond single links
        own = list(rng.choice(words, 60))
        for _ in range(10):
            own = own.copy()
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(60))] = str(rng.choice(words))
            texts[len(texts)] = " ".join(own)
    texts |= {500: None, 501: "", 502: "  \n", 503: "One Two", 504: "one\ttwo", 505: LONG[:5000], 506: LONG[:5010]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = word_sets(texts, k)
    wanted = brute_components(sets, percent)
    for r in near_dedup.near_duplicates(df, k=k, percent=percent, bands=bands).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (wanted[r.doc_id], len(sets[r.doc_id]), wanted[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("stars", [0, 2])
def test_large_buckets_are_split_without_loss(spark, monkeypatch, stars):
    monkeypatch.setattr(near_dedup, "LISTED", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "STARS", stars)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join([*base[: i % 80], f"x{i}", *base[i % 80 :]]) for i in range(40)}
    texts |= {100 + i: " ".join([f"y{i}" if j % 9 == 0 else w for j, w in enumerate(base)]) for i in range(10)}
    texts |= {200 + i: " ".join([*base[: 78 - i], *(f"z{i}" for _ in range(i))]) for i in range(20)}  # ever farther from the base
    wanted = brute_components(word_sets(texts, 3), 85)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=3, percent=85, bands=26).collect()} == wanted


def test_a_group_that_a_task_holds_is_verified_at_once(spark, monkeypatch):
    """A hundred near copies meet in one task: no hub, no shells that double their rows."""
    monkeypatch.setattr(near_dedup, "_measure", lambda *a: pytest.fail("measured against a hub"))
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join([*base[:i], f"x{i}", *base[i:]]) for i in range(100)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=3, percent=85, bands=26).collect()} == brute_components(word_sets(texts, 3), 85)


def test_repeated_ids_are_one_node(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LISTED", 2)
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(7, a), (7, b), (3, a + " more"), (9, b + " more"), (4, b), (11, a), (12, "else"), (12, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, bands=26).collect()} == {7: 3, 3: 3, 9: 3, 4: 3, 11: 3, 12: 12}


def test_near_dedup_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOC).withColumns({c: F.lit(c) for c in ("node", "bands", "component", "n")})
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == 0 and by[1].kept and by[None].component_id is None and by[None].kept
    assert by[4].component_id == 3 and by[6].component_id == 6
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 50, 5000):
        assert near_dedup.sketch(rng.integers(0, 2**63, n).astype(np.uint64), 156).max() < 2**64 - 1
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = near_dedup.sketch(pool[:120], 240), near_dedup.sketch(pool[30:], 240)
        errors.append(np.mean(a == b) - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert near_dedup.miss_probability(0.85, 26) < 1e-5 and near_dedup.miss_probability(0.8) < 1e-5


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- permutation index ----------------------------------------------------------------------


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[int(ids[i])] = [(int(ids[keep][j]), float(d[keep][j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    wanted = brute_nearest(rows, 10)
    found: dict[int, list] = {}
    for r in queries.QUERIES["op4_permutation_index"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert found.keys() == wanted.keys()
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in wanted[q]}) for q in wanted)
    assert hits / (10 * len(wanted)) >= 0.9 and permutation_index.RERANK < 0.05
    print("recall", hits / (10 * len(wanted)))
    for q, own in found.items():
        truth = dict(wanted[q])
        assert all(abs(truth[v] - s) < 1e-12 for v, s in own if v in truth)
        assert own == sorted(own, key=lambda x: (x[1], x[0]))


def test_files_are_stored_and_name_every_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 5 else 3)]) for i in range(300)]
    index = permutation_index.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=20, prefix=6, block=64)
    posted: dict[tuple, int] = {}
    for r in index.files.collect():
        if r.pivot >= 0:
            posted[r.dim, r.block] = posted.get((r.dim, r.block), 0) + len(r.members) // 4
            assert len(r.members) // 4 == len(r.places) // 2
    assert sum(posted.values()) == 6 * 300 and {d for d, _ in posted} == {3, 4} and len(posted) == 5
    found = permutation_index.search(index, index.rows.filter("vec_id % 10 = 0"), k=5, rerank=1.0, chunk=7).collect()
    for q in {r.query_id for r in found}:
        own = [np.linalg.norm(np.array(v) - rows[q][1]) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        assert [r.score for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == pytest.approx(sorted(own)[:5])


def test_index_of_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (1, same), (2, same), (3, None), (4, [0.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, [1.0]), (100, same), (None, same), (9, [float("inf"), 1.0]), (1, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    index = permutation_index.build_index(df, block=2)
    assert index.count == 6  # the vector of another dimension is an index of its own
    found = permutation_index.search(index, index.rows.filter("vec_id % 100 = 0"), k=3).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == {(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 1, 0.0)}
    lone = permutation_index.search(index, index.rows.filter("vec_id = 7"), k=3)
    assert lone.count() == 0
    empty = permutation_index.build_index(df.limit(0))
    assert permutation_index.search(empty, empty.rows).count() == 0
