"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import constant, hash_sample, materialize

# The base patterns, the group whose length counts and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the maximal runs of [0-9a-f] that are long enough
)
LEARNED = "markov"
KINDS = (*(b[0] for b in BASE), LEARNED)
#: Characters below which a string carries too little evidence for the Markov models.
LEAST = 12
#: Runs that they judge, and the parts of a run that is not random as a whole.
CANDIDATES = (f"[A-Za-z0-9+/_=-]{{{LEAST},}}", f"[A-Za-z0-9+_-]{{{LEAST},}}")

#: A noncharacter marks matches; one that a text holds is first exchanged for another.
MARK, SPARE = "﷐", "﷑"

# symbols of the chains: letters, digits, and one for all of + / _ = -
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SYMBOLS = len(ALPHABET) + 1
CODES = tuple(ALPHABET.find(chr(i)) if chr(i) in ALPHABET else SYMBOLS - 1 for i in range(128))


def _codes(text: Column) -> Column:
    """Array of symbol numbers of an ASCII string, in one pass over it."""
    table = constant(CODES, "int")
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.element_at(table, F.least(F.ascii(c), F.lit(127)) + 1))


def _pairs(codes: Column) -> Column:
    """Numbers of adjacent symbol pairs."""
    n = F.size(codes)
    return F.when(n > 1, F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * SYMBOLS + b)).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio of each symbol pair, random over ordinary, and the threshold of a string's sum."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, text: Column) -> Column:
        """Log-likelihood ratio of an ASCII string: the sum over its pairs; 0 where it has none."""
        table = constant(self.ratios, "double")
        return F.aggregate(_pairs(_codes(text)), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))


def train(samples: DataFrame, text_col: str = "text", label_col: str = "random", alpha: float = 0.5, missed: float = 0.05, mistaken: float = 0.001) -> MarkovPair:
    """Fit both chains and their threshold on labelled strings: label 1 random, 0 an ordinary identifier.

    Three quarters of the strings, by a hash, give the counts; ``alpha`` smooths. The rest sets the
    threshold: at most a share ``missed`` of its random strings, cut to LEAST characters, and a share
    ``mistaken`` of its ordinary ones of that length or more lie on the wrong side (the greater of both
    bounds holds). The driver gets at most 2 * 63^2 counts. Rows with a null text or label don't
    count; with no rows all ratios are 0 and nothing passes.
    """
    known = samples.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("s"))
    aside = F.pmod(F.xxhash64("s"), F.lit(4)) == 0
    pairs = known.filter(~aside).select("y", F.explode(_pairs(_codes(F.col("s")))).alias("pair"))
    counts = [[alpha] * SYMBOLS**2 for _ in range(2)]
    for y, pair, n in pairs.groupBy("y", "pair").count().collect():
        counts[1 if y else 0][pair] += n
    logs = []
    for c in counts:
        totals = [sum(c[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        logs.append([math.log(x / totals[k // SYMBOLS]) for k, x in enumerate(c)])
    fitted = MarkovPair(tuple(r - o for o, r in zip(*logs, strict=True)), 0.0)
    judged = known.filter(aside & (F.length("s") >= LEAST)).withColumn("s", F.when(F.col("y") == 1, F.substring("s", 1, LEAST)).otherwise(F.col("s")))
    bound = lambda y, share: F.percentile_approx(F.when(F.col("y") == y, F.col("score")), share, 10_000)
    bounds = judged.select("y", fitted.score(F.col("s")).alias("score")).agg(bound(1, missed), bound(0, 1 - mistaken)).first()
    return MarkovPair(fitted.ratios, max((b for b in bounds if b is not None), default=0.0))


def random_strings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled random strings, made from digests of 0 .. n-1: base64, upper-case alphanumeric, hex."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    upper = F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    kind = F.col("id") % 3
    return spark.range(n).select(F.when(kind == 0, base64).when(kind == 1, upper).otherwise(F.substring(digest, 1, 48)).alias("text"), F.lit(1).alias("random"))


def ordinary_strings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 1000) -> DataFrame:
    """Labelled ordinary strings: ASCII words of at most ``max_rows`` documents with no base match.

    The sample is bounded by that parameter and picked by a hash of the id. Only the fit sees it.
    """
    clean = F.lit(True)
    for _, pattern, _, _ in BASE:
        clean = clean & ~F.col(text_col).rlike(pattern)
    picked = hash_sample(docs.select(id_col, text_col), max_rows, id_col).filter(clean)
    words = picked.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("text"))
    listed = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(IDENTIFIERS)), " ")).alias("text"))
    return words.unionByName(listed).withColumn("random", F.lit(0))


# Ordinary identifiers that also hold digits, capitals or joints.
IDENTIFIERS = (
    "application_configuration", "AbstractConnectionFactory", "background-color-transition", "calculateTotalAmount",
    "customer_order_history", "DatabaseConnectionManager", "documentation/reference/index", "getElementsByClassName",
    "internationalization", "MAX_CONNECTION_TIMEOUT", "notification_preferences", "organizationIdentifier",
    "permissions/administrators", "repository_maintenance_window", "responsibilities", "SerializationException",
    "synchronization-service", "temporary_directory_name", "transactionIsolationLevel", "user_authentication_required",
    "version_2024_release_notes", "viewportWidthBreakpoint", "wiki/Special/RecentChanges", "year_2023_quarter_4_report",
)


#: Elements of an array, and code points of a text, that the functions below handle as one block (even).
BLOCK = 1024


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))


def _running(values: Column, combine) -> Column:
    """``combine`` of all elements up to each place, of an array of integers; its cost grows in proportion.

    An array that grows by one element is copied each time, so blocks are run through on their own
    and then raised by what stands before them.
    """

    def run(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, combine(F.element_at(acc, -1), x)).otherwise(x))))

    def raised(blocks: Column) -> Column:
        tops = run(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(None).cast("int")), F.slice(tops, 1, F.size(blocks) - 1)), lambda b, top: F.transform(b, lambda x: F.when(top.isNull(), x).otherwise(combine(top, x)))))

    return F.when(F.size(values) > 0, _let(F.transform(_blocks(values), run), raised)).otherwise(F.array().cast("array<int>"))


SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, order: int, name: str, pattern: str, accept) -> Column:
    """Array of (start, order, end, name) of the accepted leftmost non-overlapping matches, in code points."""

    def found(pieces: Column) -> Column:
        ends = _let(F.transform(pieces, F.length), lambda sizes: _running(sizes, lambda a, b: a + b))
        placed = F.zip_with(pieces, ends, lambda piece, end: F.struct(piece.alias("piece"), end.alias("end")))

        def span(x: Column, k: Column) -> Column:  # matches stand at odd places
            own = F.struct((x["end"] - F.length(x["piece"])).alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(name).alias("kind"))
            return F.when((k % 2 == 1) & accept(x["piece"]), own)

        return F.filter(F.transform(placed, span), lambda x: x.isNotNull())

    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return F.when(F.contains(marked, F.lit(MARK)), _let(F.split(marked, MARK, -1), found)).otherwise(F.array().cast(SPANS))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start .. end of a text given as blocks of BLOCK code points."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = F.substring(F.element_at(blocks, first + 1), start % BLOCK + 1, F.least(end - start, F.lit(BLOCK)))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.element_at(blocks, last + 1), F.lit(1), end - last * BLOCK)
    return F.when(end <= start, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, tail))


def _filled(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(length)`` in place of every span; spans, by start, may overlap and are then filled by turns."""

    def joined_up(parts: Column) -> Column:
        blocks, own, upto = parts["blocks"], parts["own"], parts["upto"]
        before = F.concat(F.array(F.lit(0)), F.slice(upto, 1, F.size(upto) - 1))

        def piece(x: Column) -> Column:
            at = F.greatest(x["span"]["start"], x["before"])
            return F.concat(_between(blocks, x["before"], at), fill(x["span"]["end"] - at, x["span"]["start"] >= x["before"]))

        zipped = F.filter(F.zip_with(own, before, lambda s, b: F.struct(s.alias("span"), b.alias("before"))), lambda x: x["span"]["end"] > x["before"])
        return F.concat(F.array_join(F.transform(zipped, piece), ""), _between(blocks, F.element_at(upto, -1), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    upto = _let(F.transform(spans, lambda s: s["end"]), lambda ends: _running(ends, F.greatest))
    done = _let(F.struct(cut.alias("blocks"), spans.alias("own"), upto.alias("upto")), joined_up)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def find_secrets(df: DataFrame, model: MarkovPair | None, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add column ``out``: array of (start, ord, end, kind) by start, then kind; code points, end exclusive.

    Base spans come from the fixed patterns. With a model, runs of letters, digits and joints in what
    the base spans leave of the text are added as kind ``markov`` where the log-likelihood ratio of both
    chains passes the model's threshold, and else those of their parts (between "/" and "=") that pass.
    Every whole text is searched, and the work grows in proportion to its length, however many spans it has.

    Null and empty texts have no spans. Ids are never read, so null or repeated ones make no
    difference; rows that repeat are searched each. An empty table gives no rows. All other columns
    stay; temporary ones are named ``__nl_*``.
    """
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(SPARE))
    df = df.withColumn("__nl_text", text)
    for order, (name, pattern, group, least) in enumerate(BASE):
        if group:
            df = df.withColumn(f"__nl_{name}", _spans(F.col("__nl_text"), order, name, pattern, lambda x, p=pattern, g=group, n=least: F.length(F.regexp_extract(x, p, g)) >= n))
        else:
            df = df.withColumn(f"__nl_{name}", _spans(F.col("__nl_text"), order, name, pattern, lambda x, n=least: F.length(x) >= n))
    base = F.concat(*(F.col(f"__nl_{b[0]}") for b in BASE))
    df = df.withColumn("__nl_base", F.sort_array(base))
    found = F.col("__nl_base")
    if model is not None:
        taken = F.col("__nl_base")
        for k, pattern in enumerate(CANDIDATES):
            left = F.col(f"__nl_left{k}")
            df = df.withColumn(f"__nl_left{k}", _filled(F.col(f"__nl_left{k - 1}" if k else "__nl_text"), taken, lambda n, _: F.repeat(F.lit(" "), n)))
            df = df.withColumn(f"__nl_more{k}", _spans(left, len(BASE), LEARNED, pattern, lambda x: model.score(x) > model.threshold))
            taken = F.col(f"__nl_more{k}")
        found = F.sort_array(F.concat(found, *(F.col(f"__nl_more{k}") for k in range(len(CANDIDATES)))))
    return df.withColumn(out, found).drop("__nl_text", "__nl_base", *(f"__nl_{n}{k}" for n in ("left", "more") for k in range(len(CANDIDATES))), *(f"__nl_{b[0]}" for b in BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, placeholder: str = "[secret]") -> Column:
    """``text`` with every span replaced; spans that overlap are replaced together."""
    return _filled(text, spans, lambda _, first: F.when(first, F.lit(placeholder)).otherwise(F.lit("")))


def default_model(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> MarkovPair:
    """Both chains, trained on the two bounded samples above, which are stored as two passes read them."""
    return train(materialize(random_strings(docs.sparkSession).unionByName(ordinary_strings(docs, text_col, id_col)), "strings"))
