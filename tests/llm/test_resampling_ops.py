"""Importance resampling, fill-in-the-middle and window cuts against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import fill_in_middle as middle
from notelake.llm import importance, packing, queries, window_cuts
from tests.conftest import SF, same_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string"
LONG = "Long word, é😀 and more. " * 12_000
#: Null text and id, empty, blank, sentinels, very long, repeated rows and ties; and columns with clashing names.
ODD = [(1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "a <P> b", "en"), (5, "É é a_b C\x00d  x y\x0bz ", "en"), (6, LONG, "en"), (6, LONG, "en"), (None, "x y", "en"), (None, None, "en"), (9, "one", "en"), (10, "<<P" + " <S" * 30, "en"), (11, "😀 <" * 40, "en")]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["id", "total", "n_words", "row", "score", "rank", "n", "form", "output", "length", "offset", "window", "__nl_at"]
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit(c) for c in extra}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- importance resampling ------------------------------------------------------------------


def plain_features(text, order=2):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=25):
    own = [(d, *plain_features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10_000) / ((s[k] + 1) * (big_t + 10_000)))) for k in range(10_000)]
    rows = []
    for d, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], *r[1:4], rank.get(id(r))) for r in rows), key=repr)


def test_resampling_query_matches_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    rows = queries.QUERIES["op11_importance_resampling"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=repr) == plain_resample(docs, target)


def test_resampling_of_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("Long word, é😀",), (None,), ("",)], "text string")
    rows = importance.resample(odd, target, percent=50).collect()
    own = sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in rows), key=repr)
    expected = plain_resample([(d, t) for d, t, _ in ODD], ["Long word, é😀"], 50)
    assert own == sorted((r[:4] for r in expected), key=repr)
    assert sorted(r["rank"] for r in rows if r["rank"]) == sorted(r[4] for r in expected if r[4])
    assert importance.resample(none, target).count() == 0
    assert {r.weight for r in importance.resample(odd, none).collect()} != {None}
    drawn = importance.drawn_documents(odd, importance.resample(odd, target, percent=100))
    assert drawn.columns == odd.columns and {r.doc_id for r in drawn.collect()} == {6, 10, 11} & {r.doc_id for r in rows if r.n_words >= 20}


def test_ranks_run_over_all_ranges(spark):
    rows = [(k, 30, 59, 0, k % 7) for k in range(5000)] + [(None, 30, 59, 0, 3)] * 500 + [(9999, 3, 5, 0, 99)]
    scored = spark.createDataFrame(rows, importance.SCORED).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = importance.draw(scored, 40, 20).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 2201)) and len(found) == len(rows)
    expected = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    assert [(r.score, r.id) for r in ranked] == [(r[4], r[0]) for r in expected[:2200]]


@settings(max_examples=40, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "Bc", "é", "😀", " ", "  ", "-", "x" * 30, "1", "\x00"]), max_size=60).map("".join), chars=st.integers(1, 25), order=st.integers(1, 3))
def test_pieces_count_every_run_once(text, chars, order):
    counter = importance.Counter(order, 10_000, chars)
    rows = [*counter.add(1, text), *counter.add(2, "tail word"), *counter.close()]
    assert [r[0] for r in rows] == [1, 2, None]
    n, features = plain_features(text, order)
    assert rows[0][2] == n and dict(zip(rows[0][4].tolist(), rows[0][5].tolist(), strict=True)) == dict(Counter(features))
    assert rows[2][2] == n + 2 and rows[2][3] == len(features) + (2 if order == 1 else 3)


# --- fill in the middle ---------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in middle.SENTINELS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


PARTS = ["a", "Bc", "é", "😀", " ", "\t", "\n", "\x0b", "\x0c", "\r", " ", "\x1c", "<", "<P", ">", "<P>", "<S>", "<M", "\x00", "word "]


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_unit_ends_match_the_pattern(text):
    ends, marked = middle.unit_ends(text, middle.automaton())
    assert ends.tolist() == [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    assert marked == any(s in text for s in middle.SENTINELS)


def test_unit_ends_over_several_takes(monkeypatch):
    monkeypatch.setattr(middle, "EVENTS", 2)
    text = " a  b c\n\nd   "
    assert middle.unit_ends(text, middle.automaton())[0].tolist() == [2, 5, 7, 10, 13]


def test_fill_in_middle_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(k, t, None) for k in range(20, 120) for t in ("a b  c\nd e", "tail <", "x ")], DOC)
    both = odd.select("doc_id", "text", "lang").unionByName(more)
    cut = middle.fill_in_middle(both).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    asked = both.collect()
    assert len(cut) == len(asked) and {r.form for r in cut} == {"plain", "psm", "spm"}
    expected = sorted((r.doc_id, *plain_middle(r.doc_id, r.text), r.text or "").__repr__() for r in asked)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back).__repr__() for r in cut) == expected
    assert middle.fill_in_middle(odd).count() == len(ODD) and middle.fill_in_middle(none).count() == 0


def test_sentinels_must_differ():
    with pytest.raises(ValueError, match="three different"):
        middle.automaton(("<P>", "<P>", "<M>"))


def test_fill_in_middle_query_matches_sql(spark, oracle):
    assert same_rows(queries.QUERIES["op12_fill_in_middle"](spark, SF).toPandas(), oracle(queries.ORACLE["op12_fill_in_middle"]))


# --- window cuts ----------------------------------------------------------------------------


def padding(length, window):
    return 0 if length & (length - 1) == 0 else window - length


def plain_cheapest(places, prices, window, costs):
    """Least cost of all cuttings, by trying every start of every window."""
    at, least = [0, *places], [0]
    for j in range(1, len(at)):
        least.append(min(least[i] + costs.window + padding(at[j] - at[i], window) for i in range(j) if at[j] - at[i] <= window) + prices[j - 1])
    return least[-1]


@settings(max_examples=200, deadline=None)
@given(gaps=st.lists(st.integers(1, 16), min_size=1, max_size=60), seed=st.integers(0, 999), window=st.sampled_from([16, 24, 64]), price=st.integers(0, 20))
def test_cuts_cost_the_least(gaps, seed, window, price):
    costs, rng = window_cuts.Costs(window=price), random.Random(seed)
    places, prices = np.cumsum(gaps), np.array([rng.choice([0, 2, 24]) for _ in gaps])
    cuts = window_cuts.cheapest(places, prices, window, costs)
    assert cuts[-1] == len(gaps) - 1 and cuts == sorted(set(cuts))
    bounds = [0, *(int(places[k]) for k in cuts)]
    sizes = [b - a for a, b in zip(bounds, bounds[1:])]
    assert max(sizes) <= window
    assert sum(padding(s, window) + price for s in sizes) + sum(int(prices[k]) for k in cuts) == plain_cheapest(places.tolist(), prices.tolist(), window, costs)


def check_pieces(rows, docs, window):
    """Whether the pieces are the documents' ids, each once, in gapless windows; the share of padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    asked = Counter()
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        asked[key, len(ids), tuple(ids)] += 1
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= window
    for (key, n, ids), times in asked.items():
        own = sorted((r for r in rows if r.doc_id == key and r.doc_tokens == n and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())), key=lambda r: r.start)
        if times == 1:
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == n * times
    assert sum(r.length for r in rows) == sum(n * times for (_, n, _), times in asked.items())
    return sum(padding(sum(r.length for r in own), window) for own in bins.values()) / max(1, sum(r.length for r in rows))


def test_window_query_gives_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_pieces(queries.QUERIES["op13_window_cuts"](spark, SF).collect(), docs, 2048) < 0.01


def test_windows_of_odd_rows(spark, odd, none):
    rows = window_cuts.pack_windows(odd.repartition(3), WORDS, window=256, part=1000).collect()
    assert check_pieces(rows, [(d, t) for d, t, _ in ODD], 256) < 0.02
    assert window_cuts.pack_windows(none, WORDS).count() == 0


def test_cuts_stand_at_sentence_ends():
    ends = window_cuts.SentenceEnds(WORDS)
    ids = np.array(packing.WordEncoder(WORDS).tokenizer.encode('It costs 3.14 euro. "Really?" Yes!', add_special_tokens=False).ids + [1])
    words = [packing.WordEncoder(WORDS).tokenizer.id_to_token(int(ids[k - 1])) for k in ends.of(ids)]
    assert words == [".</w>", '?"</w>', "!</w>"]


# --- words that share a hash ----------------------------------------------------------------

CLASH = ("auwwfyyyaadaabaa", "zykljfezwþymùcéä")


def test_words_of_one_hash_keep_their_own_ids():
    whole = packing.WordEncoder(WORDS)
    texts = [f"see {w} now" for w in CLASH]
    right = whole.whole(texts)
    data = " ".join(CLASH).encode("latin-1") + b"        "
    hashes = packing.WordEncoder._hash(data, np.array([0, 17]), np.array([16, 16]))
    assert hashes[0] == hashes[1] and right[0] != right[1]
    assert packing.WordEncoder(WORDS).encode(texts) == right
    assert packing.WordEncoder(WORDS).encode([" ".join(texts)]) == whole.whole([" ".join(texts)])
    other = packing.WordEncoder(WORDS)
    assert [other.encode([t])[0] for t in texts] == right and other.encode(texts[::-1]) == right[::-1]
    other.KEEP = 1  # the kept words are forgotten before each batch
    assert [other.encode([t])[0] for t in texts] == right
