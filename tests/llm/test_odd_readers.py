"""Archives of other writers, repeated queries, and signs that are no letters."""

import gzip
import io
import zipfile

import pytest

from notelake.llm import language, permutation_index, warc_zip


def warc(kind, body, **extra):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in extra.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def archive(members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return warc_zip.ArchiveReader(raw)


@pytest.mark.parametrize("step", [1, 7, 64, 10**6])
def test_many_records_in_one_gzip_member(monkeypatch, step):
    bodies = [b"", b"one", b"\r\n\r\n" * 9, bytes(range(256)) * 40, b"last"]
    records = [warc("resource", b, WARC_Target_URI=f"http://a.example/{k}") for k, b in enumerate(bodies)]
    data = gzip.compress(b"".join(records)) + gzip.compress(records[1]) + gzip.compress(records[3] + records[0])
    reader = archive({"archive/a.warc.gz": data})
    monkeypatch.setattr(warc_zip, "READ_BYTES", step)
    whole = reader.read

    def short(name, at=0, n=None):
        return whole(name, at, n if n is None else min(n, step))

    monkeypatch.setattr(reader, "read", short)
    found = [(r["url"][-1], r["payload"]) for r in reader.records(most=10**6) if True] if step == 10**6 else [(warc_zip.parse_record(r)["url"][-1], warc_zip.parse_record(r)["payload"]) for _, r, _ in reader._unpacked("archive/a.warc.gz", 0)]
    expected = [(str(k), b) for k, b in enumerate(bodies)]
    assert found == (expected + [expected[1], expected[3], expected[0]] if step == 10**6 else expected)
    assert len(list(reader._walk("archive/a.warc.gz"))) == 8


def test_records_asked_for_within_a_member():
    records = [warc("resource", b"x%d" % k, WARC_Target_URI=f"u{k}") for k in range(6)]
    reader = archive({"archive/a.warc.gz": gzip.compress(b"".join(records))})
    entries = reader.index()
    assert [r["payload"] for r in reader.records(entries[2:4])] == [b"x2", b"x3"]


def test_a_last_record_without_lines_after_it():
    reader = archive({"archive/a.warc.gz": gzip.compress(warc("resource", b"one") + warc("resource", b"two")[:-4])})
    assert [r["payload"] for r in reader.records()] == [b"one", b"two"]


@pytest.mark.parametrize("cut", [3, 40, 61])
def test_members_that_end_within_a_record(cut):
    whole = warc("resource", b"one") + warc("resource", b"two" * 20)
    reader = archive({"archive/a.warc.gz": gzip.compress(whole[: len(warc("resource", b"one")) + cut])})
    with pytest.raises(ValueError, match="ends within|without content"):
        list(reader.records())


@pytest.mark.parametrize(("record", "missing"), [(b"WARC/1.0\r\nWARC-Type: x\r\n\r\nbody", "content-length"), (b"WARC/1.0\r\nContent-Length: 4\r\n\r\nbody", "warc-type")])
def test_records_without_a_field_are_refused_by_name(record, missing):
    with pytest.raises(ValueError, match=missing):
        warc_zip.parse_record(record)


def test_repeated_query_rows_have_their_own_neighbours(spark):
    rows = [(k, [float(k), 1.0, 0.5]) for k in range(40)] + [(7, [7.0, 1.0, 0.5]), (9, [30.2, 1.0, 0.5])]
    index = permutation_index.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = permutation_index.search(index, index.rows.filter("vec_id in (7, 9, 11)"), k=4, rerank=1.0).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in found)
    expected = []
    for own, q in rows:
        if own in (7, 9, 11):
            near = sorted((abs(q[0] - v[0]), k) for k, v in rows if k != own)[:4]
            expected += [(own, at + 1, k, round(d, 6)) for at, (d, k) in enumerate(near)]
    assert got == sorted(expected)


def test_numbers_and_signs_are_no_letters(spark):
    texts = ["½ ² ٣ 12 _", "½a", "!?", "٣ب", "", None]
    model = language.train([("abc", "en")], steps=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert found == {0: "und", 1: "en", 2: "und", 3: "en", 4: "und", 5: "und"}
