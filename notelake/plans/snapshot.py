"""Versioned tables on plain Parquet: immutable folders, and a manifest a generation that names them.

Rows are dealt into buckets by the low bits of a hash of their note's path. A table's directory, which
buckets there are and how many bits each looks at, stands in the manifest, so readers need no settings;
a bucket that grows beyond a size is split alone into those that look at more bits. An
update adds to the touched buckets a delta: new rows, and a mark for each touched note that hides
its older rows. Deltas are merged by size, first with each other, then into their bucket. The
manifest of a generation is created exclusively, so of two writers that built on one generation the
second fails. Readers hold the generation they began with; data goes once no manifest that is kept
names it. All files are reached through Spark's own file systems.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


class Conflict(RuntimeError):
    """The store has moved on since the caller read it."""


class _Files:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file came to be, whole; False if there is one of that name."""
        target, new = self.at(name), self.at(f"new/{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(new)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.local:  # a local rename would replace the file; a link doesn't
                os.link(new.toUri().getPath(), target.toUri().getPath())
                return True
            return not self.fs.exists(target) and self.fs.rename(new, target)
        except FileExistsError:
            return False
        finally:
            self.fs.delete(new, False)

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def older(self, folder: str, seconds: float) -> list[str]:
        """Names in a folder that nothing has been added to for so long."""
        path, now = self.at(folder), time.time()
        found = self.fs.listStatus(path) if self.fs.exists(path) else []
        return [s.getPath().getName() for s in found if now - s.getModificationTime() / 1000 > seconds]


#: Bits a bucket looks at, at most; beyond 65,536 buckets a bucket has several files.
MOST_BITS = 16
#: Bytes of text in a piece that is dealt to a task, at most, and the least worth a task of its own.
PIECE, LEAST_PIECE = 16 << 20, 1 << 20
#: Deltas of a bucket before they are merged into one.
MOST_DELTAS = 8
#: How a delta tells the order of updates, and marks a touched note.
SEQ, GONE = "_seq", "_gone"


class SnapshotStore:
    """Tables below a folder that driver and executors reach.

    The newest ``keep`` generations stay, and all that are younger than ``grace`` seconds, for readers
    that hold them; so do intermediate tables of jobs that died. ``bucket_bytes`` is the size at which
    buckets are split; it only matters to writers.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, grace: float = 3600.0, bucket_bytes: int = 64 << 20) -> None:
        self.spark, self.root, self.keep, self.grace, self.bucket_bytes = spark, root.rstrip("/"), keep, grace, bucket_bytes
        self.files = _Files(spark, self.root)

    # --- generations ------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    @property
    def generation(self) -> int:
        return max(self._numbers(), default=0)

    def manifest(self, generation: int | None = None) -> dict | None:
        """Generation, its tables, derivation fingerprint and markers; None before the first one."""
        number = generation or self.generation
        return json.loads(self.files.read(f"manifests/{number:012d}.json")) if number else None

    def read(self, table: str, found: dict | None = None) -> DataFrame:
        """A table of the current generation, or of the manifest ``found``."""
        found = found or self.manifest()
        if not found or table not in found["tables"]:
            raise LookupError(f"no table {table!r}")
        return self._open(found["tables"][table])

    def tables(self, found: dict | None = None) -> dict[str, DataFrame]:
        found = found or self.manifest()
        return {t: self._open(own) for t, own in found["tables"].items()} if found else {}

    # --- the directory of a table -----------------------------------------------------------

    @staticmethod
    def _bucket(key: str | None, names: list[str]) -> Column:
        """The place in ``names`` (bits.value, no bucket within another) of the bucket that a row is in."""
        own = [tuple(map(int, n.split("."))) for n in names]
        deep = max(bits for bits, _ in own)
        if key is None or not deep:
            return F.lit(0)
        at = {b: k for k, b in enumerate(own)}
        places = [next(at[bits, v & (1 << bits) - 1] for bits in range(deep, -1, -1) if (bits, v & (1 << bits) - 1) in at) for v in range(1 << deep)]
        directory = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")  # one literal, folded once
        return F.element_at(directory, (F.xxhash64(key).bitwiseAND((1 << deep) - 1) + 1).cast("int"))

    def _open(self, own: dict, names: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets: those that no later mark hides."""
        schema, key = StructType.fromJson(own["schema"]), own["key"]
        buckets = [b for n, b in own["buckets"].items() if names is None or n in names]
        bases = [f"{self.root}/{b['base']}" for b in buckets if b["base"]]
        deltas = [f"{self.root}/{d['folder']}" for b in buckets for d in b["deltas"]]
        base = self.spark.read.schema(schema).parquet(*bases) if bases else self.spark.createDataFrame([], schema)
        if not deltas:
            return base
        later = self.spark.read.schema(_delta_schema(schema)).parquet(*deltas)
        marks = later.filter(GONE).groupBy(F.col(key).alias("_key")).agg(F.max(SEQ).alias("_last"))
        fresh = later.filter(~F.col(GONE)).join(marks, (F.col(key) == F.col("_key")) & (F.col(SEQ) == F.col("_last")), "left_semi")
        return base.join(marks, base[key] == marks["_key"], "left_anti").unionByName(fresh.select(*schema.fieldNames()))

    # --- intermediate tables ----------------------------------------------------------------

    @contextmanager
    def job(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes tables out, which then stay as they are whatever happens to executors or files.

        They lie in a folder of this job alone, which goes when the job ends.
        """
        folder = f"stage/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = f"{self.root}/{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self.files.drop(folder)

    # --- writing ----------------------------------------------------------------------------

    def _write(self, path: str, df: DataFrame, key: str | None, names: list[str], dealt: bool = False) -> dict[str, str]:
        """Write rows by bucket; the folders by the buckets' names. Rows that are ``dealt`` already stay in their tasks."""
        bucketed = df.withColumn("_bucket", self._bucket(key, names))
        bucketed = bucketed if dealt else bucketed.hint("rebalance", "_bucket")
        order = ["_bucket", *(c for c in ("term",) if c in df.columns)]
        bucketed.sortWithinPartitions(*order).write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return {names[int(n.partition("=")[2])]: f"{path}/{n}" for n in self.files.names(path) if n.startswith("_bucket=")}

    def deal(self, rows: DataFrame, key: str, size: int) -> DataFrame:
        """Rows, of a table whose texts have ``size`` bytes, dealt into pieces each of which lies in one bucket.

        What is made of them row by row is dealt too, so ``publish`` needs not shuffle it.
        """
        pieces = max(math.ceil(size / PIECE), min(2 * self.spark.sparkContext.defaultParallelism, math.ceil(size / LEAST_PIECE)), 1)
        n = 1 << max(_bits(size, self.bucket_bytes), min(MOST_BITS, math.ceil(math.log2(pieces))))
        return rows.repartition(n, F.xxhash64(key).bitwiseAND(n - 1))

    def _based(self, folder: str, df: DataFrame, key: str | None, names: list[str], dealt: bool = False) -> dict[str, dict]:
        made = self._write(f"{folder}/{uuid.uuid4().hex}", df, key, names, dealt)
        return {n: {"base": made.get(n), "bytes": self.files.bytes(made[n]) if n in made else 0, "deltas": []} for n in names}

    def _split(self, folder: str, own: dict) -> None:
        """Split buckets over the size, each alone, until none is."""
        while large := [n for n, b in own["buckets"].items() if b["bytes"] > self.bucket_bytes and int(n.split(".")[0]) < MOST_BITS and not b["deltas"]]:
            self._rebase(folder, own, large)

    def _rebase(self, folder: str, own: dict, names: list[str]) -> None:
        """Write buckets anew without deltas, those over the size as so many that each is about under it: one pass, whatever the size."""
        after: list[str] = []
        for n in names:
            bits, value = map(int, n.split("."))
            b = own["buckets"][n]
            times = (b["bytes"] + sum(d["bytes"] for d in b["deltas"])) / self.bucket_bytes
            more = min(MOST_BITS - bits, math.ceil(math.log2(times))) if own["key"] and times > 1 else 0
            after += [f"{bits + more}.{value + (k << bits)}" for k in range(1 << more)]
        rows = self._open(own, names)
        rest = {n: b for n, b in own["buckets"].items() if n not in names}
        # places count over the whole directory; the rows are those of these buckets only
        made = self._write(f"{folder}/{uuid.uuid4().hex}", rows, own["key"], [*after, *rest])
        own["buckets"] = rest | {n: {"base": made.get(n), "bytes": self.files.bytes(made[n]) if n in made else 0, "deltas": []} for n in after}

    def _commit(self, base: int, tables: dict, fingerprint: str, markers: dict | None) -> int:
        own = {"generation": base + 1, "tables": tables, "fingerprint": fingerprint, "markers": markers or {}, "published_at": time.time()}
        if not self.files.create(f"manifests/{base + 1:012d}.json", json.dumps(own)):
            raise Conflict("another writer published first")
        self._clean()
        return base + 1

    @staticmethod
    def _named(manifest: dict) -> set[str]:
        parts = (b for t in manifest["tables"].values() for b in t["buckets"].values())
        return {f for b in parts for f in (b["base"], *(d["folder"] for d in b["deltas"])) if f}

    def _clean(self) -> None:
        """Drop manifests that are neither new nor young, the data that only they name, and what dead jobs left."""
        for name in self.files.older("stage", max(self.grace, 3600.0)):
            self.files.drop(f"stage/{name}")
        numbers = sorted(self._numbers())
        old = {n: self.manifest(n) for n in numbers[: -self.keep] if self.keep}
        gone = {n: m for n, m in old.items() if time.time() - m["published_at"] > self.grace}
        left = [name for name in self.files.older("data", max(self.grace, 3600.0))]
        if not gone and not left:
            return
        held = set().union(*(self._named(old.get(n) or self.manifest(n)) for n in numbers if n not in gone))
        for n, m in gone.items():
            for folder in self._named(m) - held:
                self.files.drop(folder)
            self.files.drop(f"manifests/{n:012d}.json")
        inside = {f.split("/")[1] for f in held}
        for name in left:
            if name not in inside:
                self.files.drop(f"data/{name}")

    def _base(self, expected: int | None) -> dict:
        found = self.manifest() or {"generation": 0, "tables": {}, "fingerprint": "", "markers": {}}
        if expected is not None and expected != found["generation"]:
            raise Conflict(f"generation {found['generation']} is current, not {expected}")
        return found

    @contextmanager
    def _data(self) -> Iterator[str]:
        """A folder for data, which goes again unless the block ends well."""
        folder = f"data/{uuid.uuid4().hex}"
        try:
            yield folder
        except BaseException:
            self.files.drop(folder)
            raise

    def publish(self, tables: dict[str, DataFrame], fingerprint: str = "", expected: int | None = None, markers: dict | None = None, unique: dict[str, list[str]] | None = None, others: bool = False, dealt: dict[str, int] | None = None) -> int:
        """Write tables as a generation and make it current; with ``others`` the tables not given stay as they are.

        ``unique`` names keys that no two rows of a table may share. A table that exists keeps its directory.
        ``dealt`` names tables made of rows that ``deal`` gave, with about their bytes: they are written where they lie, at once
        in as many buckets as that takes.
        """
        found = self._base(expected)
        made = dict(found["tables"]) if others else {}
        with self._data() as folder:

            def written(name: str) -> dict:
                df = tables[name]
                key = next((c for c in ("source_path", "path") if c in df.columns), None)
                before = found["tables"].get(name)
                bits = _bits((dealt or {}).get(name, 0), self.bucket_bytes) if key else 0
                names = list(before["buckets"]) if before and before["key"] == key else [f"{bits}.{v}" for v in range(1 << bits)]
                own = {"schema": df.schema.jsonValue(), "key": key, "buckets": self._based(folder, df, key, names, name in (dealt or {}))}
                keys = (unique or {}).get(name)
                if keys and not self._open(own).groupBy(*keys).count().filter("count > 1").isEmpty():
                    raise ValueError(f"{name} repeats {keys}")
                if key:
                    self._split(folder, own)
                return own

            made |= _together(written, tables)
            return self._commit(found["generation"], made, fingerprint, markers)

    def upsert(self, changed: dict[str, DataFrame | tuple[DataFrame, DataFrame]], paths: DataFrame, fingerprint: str = "", expected: int | None = None, markers: dict | None = None, dealt: Iterable[str] = ()) -> int:
        """A generation whose ``changed`` tables lack the rows of ``paths`` and have the new ones; a deletion has none to add.

        A table may bring its own paths, as (rows, paths). What is written are deltas of the touched
        buckets, and those buckets whose deltas have grown too many or too large. Other tables stay.
        ``dealt`` names tables made of rows that ``deal`` gave: they are written where they lie.
        """
        found = self._base(expected)
        made = dict(found["tables"])
        with self._data() as folder:

            def written(name: str) -> dict:
                fresh, touched = changed[name] if isinstance(changed[name], tuple) else (changed[name], paths)
                key = next(c for c in ("source_path", "path") if c in fresh.columns)
                empty = {"schema": fresh.schema.jsonValue(), "key": key, "buckets": {"0.0": {"base": None, "bytes": 0, "deltas": []}}}
                own = json.loads(json.dumps(found["tables"].get(name, empty)))
                self._add_delta(folder, own, fresh, touched, found["generation"] + 1, name in dealt)
                return own

            made |= _together(written, changed)
            return self._commit(found["generation"], made, fingerprint, markers)

    def _add_delta(self, folder: str, own: dict, fresh: DataFrame, paths: DataFrame, seq: int, dealt: bool = False) -> None:
        schema, key = StructType.fromJson(own["schema"]), own["key"]
        row = fresh.select(*schema.fieldNames(), F.lit(seq).cast("long").alias(SEQ), F.lit(False).alias(GONE))
        mark = paths.select(F.col("path").alias(key)).distinct().select(*(F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.lit(seq).cast("long").alias(SEQ), F.lit(True).alias(GONE))
        names = list(own["buckets"])
        mark = mark.repartition(len(names), self._bucket(key, names)) if dealt else mark
        made = self._write(f"{folder}/{uuid.uuid4().hex}", row.unionByName(mark), key, names, dealt)
        full, many = [], []
        for n, path in made.items():
            bucket = own["buckets"][n]
            bucket["deltas"].append({"folder": path, "bytes": self.files.bytes(path)})
            if sum(d["bytes"] for d in bucket["deltas"]) > bucket["bytes"] // 2:
                full.append(n)
            elif len(bucket["deltas"]) > MOST_DELTAS:
                many.append(n)
        if full:
            self._rebase(folder, own, full)
            self._split(folder, own)
        if many:
            self._merge_deltas(folder, own, many)

    def _merge_deltas(self, folder: str, own: dict, names: list[str]) -> None:
        """One delta in place of many: the marks, each at its last update, and the rows of that update."""
        key, schema = own["key"], _delta_schema(StructType.fromJson(own["schema"]))
        later = self.spark.read.schema(schema).parquet(*(f"{self.root}/{d['folder']}" for n in names for d in own["buckets"][n]["deltas"]))
        last = later.filter(GONE).groupBy(F.col(key).alias("_key")).agg(F.max(SEQ).alias("_last"))
        kept = later.join(last, (F.col(key) == F.col("_key")) & (F.col(SEQ) == F.col("_last")), "left_semi")
        made = self._write(f"{folder}/{uuid.uuid4().hex}", kept, key, list(own["buckets"]))
        for n in names:
            own["buckets"][n]["deltas"] = [{"folder": made[n], "bytes": self.files.bytes(made[n])}]

    def replace_vectors(self, candidates: DataFrame, table: str = "vectors") -> tuple[int, DataFrame]:
        """Compare and set: candidate rows (path, expected_token, token, ordinal, ...) replace a note's vectors only if its
        stored token is the expected one (null: none stored). Returns the generation and (path, outcome), a written
        table that stays for an hour at least."""
        found = self.manifest()
        stored = self.read(table, found)
        now = stored.groupBy("path").agg(F.max("token").alias("_stored"))
        asked = candidates.select("path", "expected_token").distinct().join(now, "path", "left")
        path = f"{self.root}/stage/{uuid.uuid4().hex}"
        asked.select("path", F.when(F.col("_stored").eqNullSafe(F.col("expected_token")), "published").otherwise("conflict").alias("outcome")).write.parquet(path)
        judged = self.spark.read.parquet(path)
        won = judged.filter("outcome = 'published'").select("path")
        fresh = candidates.join(won, "path", "left_semi").select(*stored.columns)
        return self.upsert({table: fresh}, won, found["fingerprint"], found["generation"], found["markers"]), judged

    def compact(self, least: int = 25) -> bool:
        """Merge the deltas of tables that have ``least`` of them into their buckets; whether there was any."""
        found = self.manifest() or {"tables": {}}
        made, busy = dict(found["tables"]), []
        for name, own in made.items():
            waiting = [n for n, b in own["buckets"].items() if b["deltas"]]
            if sum(len(own["buckets"][n]["deltas"]) for n in waiting) >= least:
                busy.append((name, waiting))
        if not busy:
            return False
        with self._data() as folder:
            for name, waiting in busy:
                made[name] = json.loads(json.dumps(made[name]))
                self._rebase(folder, made[name], waiting)
            self._commit(found["generation"], made, found["fingerprint"], found["markers"])
        return True

    def diff(self, scanned: DataFrame, excluded: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
        """Change set between the stored documents and a scan (path, content_hash)."""
        from ..operators.history import change_set

        return change_set(self.read("documents"), scanned, "content_hash", excluded, unreadable)


def _together(work: Callable[[str], dict], names: Iterable[str]) -> dict[str, dict]:
    """What ``work`` gives for each table; several tables are written at a time, as each alone seldom fills a cluster."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(work, names), strict=True))


def _bits(size: int, bucket_bytes: int) -> int:
    """Bits of a directory whose buckets hold about ``bucket_bytes`` of ``size`` bytes at most."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(size / bucket_bytes)))) if size > 0 else 0


def _delta_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(SEQ, LongType()), StructField(GONE, BooleanType())])
