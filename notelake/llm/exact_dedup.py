"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words of 64 bits of the bitmap that tells which texts must be hashed in full; its size bounds what is broadcast.
BITMAP_WORDS = 1 << 17


def normalised(text: Column) -> Column:
    """The compared form: A-Z lower-cased, all else untouched; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _hashed(source: DataFrame, keys: DataFrame, sha: Column) -> DataFrame:
    """Rows (rid, id, sha) of ``source`` (id, norm, len, prefix): full hashes where (len, prefix) may be in ``keys``.

    The keys go to all tasks as a bitmap of fixed size, so the scan decides by itself which texts it
    reads to their end. A false hit costs a hash and changes nothing; a miss is certain.
    """
    h = F.xxhash64("len", "prefix")
    place = [F.pmod(h, F.lit(BITMAP_WORDS)).cast("int").alias("word"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int").alias("bit")]
    words = keys.select(*place).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    marked = source.select("*", F.monotonically_increasing_id().alias("rid"), *place).join(F.broadcast(materialize(words, "bitmap")), "word", "left")
    possible = F.coalesce(F.expr("getbit(bits, bit)"), F.lit(0)) == 1
    return marked.select("rid", "id", F.when(possible, sha).alias("sha"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts is kept. Lengths that occur
    once settle their rows at once; of the others, pairs (length, hash of the first
    ``prefix_chars`` characters) that occur once settle theirs; only what is left is
    compared by the SHA-256 of the whole text, in a second scan. text_sha256 is null for
    rows that were settled before; ``hash_all`` fills it for every row (all are then hashed
    in the first scan, and there is no second).

    Defined cases: null text equals empty text. Rows that repeat id and text tie, and one of
    them is kept. A null id loses against any other; if all ids of a group are null, one such
    row is kept and keep_id is null. Very long texts are hashed where they lie; only hashes
    move between tasks. An empty table gives no rows. Other columns of ``df`` are never read,
    so their names can't clash.
    """
    text = normalised(F.col(text_col))
    source = df.select(F.col(id_col).alias("id"), text.alias("norm"))
    sha = F.sha2("norm", 256)
    source = source.select("*", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    rows = source.select("id", "len", "prefix", (sha if hash_all else F.lit(None).cast("string")).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(rows, "signatures")

    # each table of groups is written, so that the joins below read plain tables and Spark can split a hot key
    lengths = materialize(rows.groupBy("len").count().filter("count > 1").select("len"), "lengths")
    same_length = rows.join(lengths, "len", "left_semi")
    prefixes = materialize(same_length.groupBy("len", "prefix").count().filter("count > 1").select("len", "prefix"), "prefixes")
    if hash_all:
        full = rows.join(prefixes, ["len", "prefix"], "left_semi")
    else:
        rows = materialize(_hashed(source, prefixes, sha), "hashed")
        full = rows.filter("sha is not null")
    groups = (
        full.groupBy("sha")
        .agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha", F.col("keep.id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"), "n")
    )
    groups = materialize(groups, "groups")
    out = rows.select("rid", "id", "sha").join(groups, "sha", "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``exact_dedup`` doesn't keep; all columns stay, whatever their names.

    Of rows that repeat both id and text one is left. Ids are compared null-safe. Texts are hashed
    in full only where ``exact_dedup`` needs it, and once more where an id repeats.
    """
    marks = exact_dedup(df, id_col, text_col).select(F.col(id_col).alias("__nl_id"), "kept", F.col("text_sha256").alias("__nl_sha"))
    marks = materialize(marks, "marks")
    gone = marks.filter("not kept").select("__nl_id", "__nl_sha").distinct()
    repeated = materialize(marks.groupBy("__nl_id").count().filter("count > 1").select("__nl_id"), "repeated")
    lost = gone.select("__nl_id").distinct()
    same_id = lambda left, right: left[id_col].eqNullSafe(right["__nl_id"])
    if repeated.isEmpty():
        lost = materialize(lost, "lost")
        # merged, not broadcast, at every size: the table of lost ids grows with the input
        return df.join(lost.hint("merge"), same_id(df, lost), "left_anti")
    leave = materialize(lost.unionByName(repeated).distinct(), "lost")
    plain = df.join(leave.hint("merge"), same_id(df, leave), "left_anti")
    # a repeated id may stand for several texts: its rows are told apart by their hashes, too
    again = df.join(repeated.hint("merge"), same_id(df, repeated), "left_semi").withColumn("__nl_key", F.sha2(normalised(F.col(text_col)), 256))
    stay = marks.filter("kept").select("__nl_id", "__nl_sha")
    same = lambda left, right: left["__nl_id"].eqNullSafe(right["__nl_id"]) & (left["__nl_sha"] == right["__nl_sha"])
    tied = materialize(gone.join(stay, same(gone, stay), "left_semi"), "tied")
    lost = materialize(gone.join(stay, same(gone, stay), "left_anti"), "lost")
    of = lambda right: same_id(again, right) & (again["__nl_key"] == right["__nl_sha"])
    single = again.join(lost, of(lost), "left_anti").join(tied, of(tied), "left_anti")
    once = again.join(tied, of(tied), "left_semi").dropDuplicates([id_col, "__nl_key"])
    return plain.unionByName(single.unionByName(once).drop("__nl_key"))
