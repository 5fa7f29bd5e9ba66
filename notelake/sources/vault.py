"""Folders of notes as a source: directory scan, parsing to rows, attachments, probes, git history, imports."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import mimetypes
import os
import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import markdown as M
from ..functions import okf
from ..functions.patterns import fnmatch_regex
from ..model import ALIASES, CITATIONS, COMMITS, DOCUMENTS, HEADINGS, LINKS, SECTIONS, TAGS, schema
from ..shared import give_back

# Fixed value: suffixes of the files beside notes that count as attachments by default.
ATTACHMENTS = frozenset(
    "pdf docx xlsx pptx odt ods odp png jpg jpeg gif webp svg bmp tiff zip tar gz mp3 mp4 wav ogg txt csv tsv json yaml toml xml html css js ts".split()
)


@dataclass(frozen=True)
class ParseOptions:
    """What derivation depends on; stored with the tables, and compared before they are used again."""

    indexed_fields: tuple[str, ...] = ("tags",)
    searchable_fields: tuple[str, ...] = ()
    title_field: str | None = None
    required_fields: tuple[str, ...] = ()
    short_lines: int = 30
    max_chunk_words: int | None = 400
    max_chunk_chars: int | None = None
    overlap_words: int = 40
    audit_chars: int | None = okf.AUDIT_CHARS  # longer notes aren't judged for evidence; None: all are
    excludes: tuple[str, ...] = ()
    attachments: frozenset[str] = field(default=ATTACHMENTS)
    chunker: object | None = field(default=None, compare=False)  # anything with chunk(content, metadata)

    def fingerprint(self) -> str:
        own = {k: sorted(v) if isinstance(v, frozenset) else v for k, v in self.__dict__.items() if k != "chunker"}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


# --- directory scan -------------------------------------------------------------------------


def excluded(path: str, patterns: Iterable[str]) -> bool:
    return any(fnmatch.fnmatchcase(path, p) for p in patterns)


def _prunable(folder: str, patterns: Iterable[str]) -> bool:
    """Whether ``PREFIX/**`` or ``**/NAME/**`` takes out all below a folder; only saves walking."""
    for p in patterns:
        if p.endswith("/**"):
            core = p[:-3]
            if core == folder or (core.startswith("**/") and not set(core[3:]) & set("*?[/") and core[3:] in folder.split("/")[1:]):
                return True
    return False


def walk(root: str, suffix: str = ".md", excludes: Iterable[str] = (), unreadable: list[str] | None = None) -> Iterator[str]:
    """Relative paths of files, hidden folders included, in order; folders that can't be read are reported."""
    base = Path(root)

    def failed(e: OSError) -> None:
        if unreadable is not None:
            unreadable.append(os.path.relpath(e.filename, root))

    for at, folders, names in os.walk(base, onerror=failed):
        here = os.path.relpath(at, base).replace(os.sep, "/")
        here = "" if here == "." else here + "/"
        folders[:] = sorted(f for f in folders if not _prunable(here + f, excludes))
        for name in sorted(names):
            if name.endswith(suffix) and not excluded(here + name, excludes):
                yield here + name


LISTED = "path string, mtime double, size long"


def listing(spark: SparkSession, root: str, suffix: str = ".md", excludes: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (path, mtime, size) of all files with a suffix, hidden folders included, in no order.

    Folders are found level by level: executors list those of a level, and what they find is written
    out by ``keep`` (or persisted); the driver sees counts only. ``root`` must be reachable by all. Links to
    folders aren't followed; a folder that can't be read gives nothing, so its notes are probed before they go.
    """
    keep = keep or DataFrame.persist

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                rows = []
                try:
                    with os.scandir(os.path.join(root, folder)) as found:
                        for entry in found:
                            path = f"{folder}/{entry.name}" if folder else entry.name
                            if entry.is_dir():
                                if not entry.is_symlink() and not _prunable(path, excludes):
                                    rows.append((path, None, None))
                            elif entry.name.endswith(suffix) and not excluded(path, excludes):
                                stat = entry.stat()
                                rows.append((path, stat.st_mtime, stat.st_size))
                            if len(rows) >= 10_000:
                                yield pd.DataFrame(rows, columns=["path", "mtime", "size"]).astype({"size": "Int64"})
                                rows = []
                except OSError:
                    pass  # what was listed before stays
                yield pd.DataFrame(rows, columns=["path", "mtime", "size"]).astype({"size": "Int64"})

    levels, level = [], spark.createDataFrame([("",)], "folder string")
    while True:
        level = keep(level.mapInPandas(run, LISTED))
        levels.append(level.filter("size is not null"))
        n = level.filter("size is null").count()
        if not n:
            break
        level = level.filter("size is null").select(F.col("path").alias("folder")).repartition(min(n, spark.sparkContext.defaultParallelism * 4))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def stat_paths(paths: DataFrame, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Rows (path, mtime, size) of those of the rows (path) that are there; executors ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    stat = os.stat(f"{root}/{path}")
                except OSError:
                    continue
                if not excluded(path, excludes):
                    rows.append((path, stat.st_mtime, stat.st_size))
            yield pd.DataFrame(rows, columns=["path", "mtime", "size"])

    return paths.select("path").mapInPandas(run, LISTED)


#: What a list of files may say of each: the hash, time and size it had when it was last derived.
KNOWN = ("known", "known_time", "known_size")


def scan(files: DataFrame, root: str) -> DataFrame:
    """Rows (path, mtime, content) of listed files; executors read. What went meanwhile is left out: a later scan decides.

    Where the list has the columns ``KNOWN``, a file that is still as they say is left out too, and ``known`` goes along.
    """
    told = set(files.columns) >= set(KNOWN)
    made = pa.schema([("path", pa.string()), ("mtime", pa.float64()), ("content", pa.binary()), *([("known", pa.string())] if told else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, mtime, *before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    data = Path(root, path).read_bytes()
                except OSError:
                    continue
                if told and before == [hashlib.sha256(data).hexdigest(), mtime, len(data)]:
                    continue
                if rows and held + len(data) > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
                    rows, held = [], 0
                rows.append((path, mtime, data, *before[:1]))
                held += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
        give_back()

    own = files.select("path", "mtime", *(KNOWN if told else ()))
    return own.mapInArrow(read, "path string, mtime double, content binary" + ", known string" * told)


def probe(root: str, path: str) -> tuple[str, str | None]:
    """(present, hash), (absent, None) or (unavailable, None); only absent allows a deletion."""
    try:
        return "present", hashlib.sha256(Path(root, path).read_bytes()).hexdigest()
    except FileNotFoundError:
        return ("absent", None) if Path(root).is_dir() else ("unavailable", None)
    except OSError:
        return "unavailable", None


def probed(paths: DataFrame, root: str) -> DataFrame:
    """Rows (path, status) of rows (path): present, absent or unavailable; executors probe, without reading."""

    def status(path: str) -> str:
        try:
            os.stat(f"{root}/{path}")
        except FileNotFoundError:
            return "absent" if Path(root).is_dir() else "unavailable"
        except OSError:
            return "unavailable"
        return "present"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "status": [status(p) for p in batch["path"]]})

    return paths.select("path").mapInPandas(run, "path string, status string")


def not_absent(paths: DataFrame, root: str) -> DataFrame:
    """Those of the rows (path) whose probe says anything but absent."""
    return probed(paths, root).filter("status <> 'absent'").select("path")


def attachments(spark: SparkSession, root: str, options: ParseOptions = ParseOptions(), pattern: str | None = None, folder: str | None = None) -> DataFrame:
    """Rows (path, folder, size, mtime, mime) of files with an allowed suffix and no hidden component."""
    found = listing(spark, root, "", options.excludes)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = {s: mimetypes.guess_type(f"x.{s}")[0] or "application/octet-stream" for s in options.attachments}
    mime = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[suffix]
    own = found.filter(~F.col("path").rlike(r"(^|/)\.") & suffix.isin(*kinds))
    out = own.select("path", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("folder"), "size", "mtime", mime.alias("mime"))
    if pattern is not None:
        out = out.filter(F.col("path").rlike(fnmatch_regex(pattern)))
    from ..functions.patterns import in_folder

    return out.filter(in_folder(F.col("folder"), folder)).orderBy("path")


def read_attachment(root: str, path: str) -> dict | None:
    """Base64 content, type, size, time and etag; None if the file is missing."""
    import base64

    try:
        data = Path(root, path).read_bytes()
    except FileNotFoundError:
        return None
    return {"content": base64.b64encode(data).decode(), "mime": mimetypes.guess_type(path)[0], "size": len(data), "mtime": os.stat(f"{root}/{path}").st_mtime, "etag": hashlib.sha256(data).hexdigest()}


# --- parsing --------------------------------------------------------------------------------


def _of(s: StructType, *drop: str) -> ArrayType:
    return ArrayType(StructType([f for f in s.fields if f.name not in drop]))


OKF = schema(type=StringType(), status=StringType(), stale=BooleanType(), trust_tier=StringType(), freshness=StringType(), findings=ArrayType(StringType()), sources_count=IntegerType(), review=StringType(), attribution=StringType(), generation=StringType())
PARSED = StructType([
    *DOCUMENTS.fields,
    StructField("sections", ArrayType(StructType([*(f for f in SECTIONS.fields if f.name != "path"), StructField("summary", StringType())]))),
    StructField("headings", _of(HEADINGS, "path")), StructField("tags", _of(TAGS, "path")), StructField("aliases", ArrayType(StringType())),
    StructField("citations", _of(CITATIONS, "path")), StructField("links", _of(LINKS, "source_path")), StructField("okf", OKF),
])


#: What every parsed row says; the other columns only where they are asked for.
ALWAYS = ("path", "skip_category")
#: Bytes of notes that are parsed before their rows go on.
SLICE_BYTES = 2_000_000


def parse_note(path: str, mtime: float, data: bytes, options: ParseOptions = ParseOptions(), now=None, columns: frozenset[str] = frozenset(PARSED.fieldNames())) -> dict:
    """One nested row; a note that can't be read as one carries a skip category and no children.

    Of a note's body only what ``columns`` ask for is derived.
    """
    from datetime import datetime

    now = now or datetime.now().astimezone()  # days end by the local calendar
    row: dict = {f.name: None for f in PARSED.fields}
    row |= {"path": path, "path_folded": path.casefold(), "folder": path.rpartition("/")[0], "modified_at": mtime, "size": len(data)}
    if "content_hash" in columns:
        row["content_hash"] = hashlib.sha256(data).hexdigest()
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        return row | {"skip_category": "decode_error", "skip_detail": str(e)}
    try:
        meta, body = M.split_front_matter(text)
        shown = M.plain(meta)
    except M.FrontMatterError as e:
        broken = {"findings": okf.findings(path, None, text, True, now)}
        return row | {"skip_category": "parse_error", "skip_detail": str(e), "okf": {f.name: broken.get(f.name) for f in OKF.fields}}
    if absent := [k for k in options.required_fields if k not in meta]:
        return row | {"skip_category": "missing_frontmatter", "skip_detail": ", ".join(absent)}
    try:
        a = okf.annotate(meta, now)
        summary = "\n".join(f"{k}: {', '.join(M.scalars(meta[k]))}" for k in options.searchable_fields if k in meta)
        names = [n for key in ("aliases", "alias") if key in meta for n in M.scalars(meta[key])]
        row |= {
            "frontmatter_json": json.dumps(shown, ensure_ascii=False), "frontmatter": {str(k): M.scalars(v) for k, v in meta.items()}, "content_chars": len(body),
            "tags": [{"tag_key": k, "tag_value": v} for k in options.indexed_fields if k in meta for v in M.scalars(meta[k])],
            "aliases": list(dict.fromkeys(names)),
        }
        if columns & {"sections", "chunk_count"}:
            chunker = options.chunker or M.HeadingChunker(options.short_lines, options.max_chunk_words, options.max_chunk_chars, options.overlap_words)
            chunks = chunker.chunk(body, meta)
            row["chunk_count"] = len(chunks)
            row["sections"] = [{"ordinal": k, "heading": c.heading, "heading_level": c.heading_level, "content": c.content, "start_line": c.start_line, "summary": summary if not k else ""} for k, c in enumerate(chunks)]
        if "title" in columns:
            row["title"] = M.title_of(meta, body, path, options.title_field)
        if "headings" in columns:
            row["headings"] = [{"position": k, "heading": h, "heading_level": lv} for k, (lv, h, _) in enumerate(M.headings(body))]
        if "citations" in columns:
            row["citations"] = [{"label": lb, "status": s, "occurrences": n, "resource": r} for lb, s, n, r in M.citations(meta, body)]
        if "links" in columns:
            row["links"] = [{"link_ordinal": k, "target_path": x.target, "link_text": x.text, "link_type": x.kind, "fragment": x.fragment, "raw_target": x.raw} for k, x in enumerate(M.links(body, path, options.attachments))]
        if "okf" in columns:
            row["okf"] = {k: a[k] for k in ("type", "status", "stale", "trust_tier", "freshness", "sources_count", "generation")} | {k: a[k]["state"] for k in ("review", "attribution")} | {"findings": okf.findings(path, meta, body, body != text, now, options.audit_chars)}
        return row
    except (ValueError, TypeError, RecursionError) as e:
        kept = ("path", "path_folded", "folder", "content_hash", "modified_at", "size")
        return dict.fromkeys(row) | {k: row[k] for k in kept} | {"skip_category": "internal_error", "skip_detail": f"{type(e).__name__}: {e}"}


def parse(files: DataFrame, options: ParseOptions = ParseOptions(), columns: tuple[str, ...] | None = None, known: bool = False) -> DataFrame:
    """Nested rows of scanned files; no shuffle. With ``columns`` only those, beside ``ALWAYS``, are derived.

    A task holds a slice of bounded bytes and its rows at a time; only a single longer note exceeds it. With
    ``known`` the hash that ``scan`` sends along is a column too.
    """
    wanted = StructType([*(f for f in PARSED.fields if columns is None or f.name in (*ALWAYS, *columns)), *([StructField("known", StringType())] if known else [])])
    asked, arrow = frozenset(wanted.fieldNames()), to_arrow_schema(wanted)
    taken = ("path", "mtime", "content", *(["known"] if known else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, mtime, content, *before in zip(*(batch.column(c) for c in taken), strict=True):
                data = bytes(content.as_py())
                if rows and held + len(data) > SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
                row = parse_note(path.as_py(), mtime.as_py(), data, options, columns=asked)
                rows.append(row | {"known": before[0].as_py()} if known else row)
                held += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            del rows
        give_back()

    return files.select(*taken).mapInArrow(run, wanted)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The derived tables of nested rows; those whose columns were parsed."""
    has = set(parsed.columns)
    each = lambda name: parsed.filter("skip_category is null").select("path", F.explode(name).alias("x"))
    out = {name: each(name).select("path", "x.*") for name in ("sections", "headings", "tags", "citations") if name in has}
    if has >= set(DOCUMENTS.fieldNames()):
        out["documents"] = parsed.select(*DOCUMENTS.fieldNames())
    if "aliases" in has:
        out["aliases"] = each("aliases").select("path", F.col("x").alias("alias")).select(*ALIASES.fieldNames())
    if "links" in has:
        out["links"] = each("links").select(F.col("path").alias("source_path"), "x.*").select(*LINKS.fieldNames())
    if "okf" in has:
        # notes whose block can't be parsed have findings too, but no derived values
        out["okf"] = parsed.filter("okf is not null").select("path", "okf.*")
    return out


def _titles(texts: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else M.title_of(*M.split_front_matter(t), p or "") for t, p in zip(texts, paths, strict=True)], dtype=object)


def register_functions(spark: SparkSession) -> None:
    """The engine's text functions for SQL users: casefold, stem_terms, note_title."""
    from ..functions import text as T

    spark.udf.register("casefold", F.pandas_udf(lambda s: s.map(lambda x: None if x is None else x.casefold()), StringType()))
    spark.udf.register("note_title", F.pandas_udf(_titles, StringType()))
    spark.udf.register("stem_terms", F.pandas_udf(lambda s: s.map(lambda x: T.terms(x or "")), ArrayType(StringType())))


# --- git ------------------------------------------------------------------------------------


#: Commits that a task reads of a repository's log.
LOG_PART = 2000
_ENTRY = "--format=%x01%H%x02%an%x02%ct%x02%s"
#: Names of a note that are followed, the present one among them.
MOST_NAMES = 16


def _entries(root: str, *asked: str) -> Iterator[tuple[tuple[str, str, float, str], list[tuple[str, ...]]]]:
    """((sha, author, time, subject), [(status, names...), ...]) of a log, newest first, read as git writes it."""
    command = ["git", "-C", root, "log", "-z", "-M", "--name-status", _ENTRY, *asked]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as git:
        held = b""
        try:
            while data := git.stdout.read(1 << 20):
                *whole, held = (held + data).split(b"\x01")
                yield from (_entry(x) for x in whole if x)
            if held:
                yield _entry(held)
        finally:
            git.stdout.close()
        if git.wait() > 0:
            raise RuntimeError(git.stderr.read().decode("utf-8", "replace").strip())


def _entry(data: bytes) -> tuple[tuple[str, str, float, str], list[tuple[str, ...]]]:
    head, *fields = data.decode("utf-8", "replace").split("\0")
    sha, author, at, subject = head.split("\x02")
    left, touched = [f.lstrip("\n") for f in fields if f.strip("\n")], []
    while left:
        n = 3 if left[0][0] in "RC" else 2  # a rename or copy has two names
        touched.append(tuple(left[:n]))
        left = left[n:]
    return (sha, author, float(at), subject.strip()), touched


def _followed(root: str, path: str, revision: str = "HEAD") -> Iterator[tuple[tuple[str, str, float, str], str]]:
    """(commit, name in it) of the commits that touched a note, newest first, under all its names.

    The commit that made the note is the last: what had its name before, moved away or deleted, is another note.
    """
    names = 1
    for commit, touched in _entries(root, "--follow", revision, "--", path):
        for status, *own in touched:
            yield commit, own[-1]
            if status == "A" or (status[0] in "RC" and names == MOST_NAMES):
                return
            names += status[0] in "RC"


def git_log(spark: SparkSession, root: str, limit: int | None = None, path: str | None = None) -> DataFrame:
    """Commits of the repository at ``root``, newest first, with the paths each touched; all, or the newest ``limit``.

    Executors read the log, each task a range of commits. With ``path`` the commits of that note alone,
    followed through renames, under the name it had then, from the one that made it.
    """
    if path is not None:
        rows = [(*commit, [name]) for commit, name in islice(_followed(root, path), limit)]
        return spark.createDataFrame(rows, COMMITS)
    counted = subprocess.run(["git", "-C", root, "rev-list", "--count", "HEAD"], capture_output=True, text=True)
    n = int(counted.stdout) if not counted.returncode else 0  # a repository without commits has no head
    n = n if limit is None else min(n, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["id"]:
                rows = [(*commit, [own[-1] for _, *own in touched]) for commit, touched in _entries(root, f"--skip={start}", f"-{min(LOG_PART, n - start)}", "HEAD")]
                yield pd.DataFrame(rows, columns=COMMITS.fieldNames())

    parts = -(-n // LOG_PART)
    return spark.range(0, n, LOG_PART, max(1, parts)).mapInPandas(run, COMMITS)


def git_diff(root: str, path: str, since: str, until: str = "HEAD", cap: int = 50_000) -> str:
    """What changed in a path between two revisions, at most ``cap`` bytes."""
    return _capped(["git", "-C", root, "diff", since, until, "--", path], cap)


def git_commit_diff(root: str, path: str, revision: str, cap: int = 50_000) -> str:
    """What one commit changed in a path, at most ``cap`` bytes."""
    return _capped(["git", "-C", root, "show", "--format=", revision, "--", path], cap)


def _capped(command: list[str], cap: int) -> str:
    out = subprocess.run(command, capture_output=True, check=True).stdout
    return out.decode("utf-8", "replace") if len(out) <= cap else out[:cap].decode("utf-8", "ignore") + "\n[cut]"


def git_show(root: str, path: str, revision: str) -> bytes | None:
    """A note's bytes at a commit, under the name it had then; None if it wasn't there."""
    known = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", f"{revision}^{{commit}}"], capture_output=True)
    if known.returncode:
        return None
    for (sha, *_), name in _followed(root, path):
        # the newest commit of the note that the revision holds tells its name
        if not subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", sha, revision], capture_output=True).returncode:
            out = subprocess.run(["git", "-C", root, "show", f"{revision}:{name}"], capture_output=True)
            return out.stdout if not out.returncode else None
    return None


def committed_revision(root: str, path: str) -> str | None:
    """The newest commit that touched a note; None if none has or the file isn't as committed."""
    changed = subprocess.run(["git", "-C", root, "status", "--porcelain", "--", path], capture_output=True, text=True)
    if changed.returncode or changed.stdout.strip():
        return None
    return next((commit[0] for commit, _ in _followed(root, path)), None)


def lineage(root: str, path: str, most: int = MOST_NAMES) -> list[str]:
    """Earlier names of a note, newest first, up to the commit that made it."""
    try:
        names = dict.fromkeys(name for _, name in _followed(root, path))
    except RuntimeError:
        return []
    return [n for n in names if n != path][:most]


def git_head(root: str) -> str | None:
    out = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return out.stdout.strip() if not out.returncode else None


# --- vector imports -------------------------------------------------------------------------


_VECTORS = "path string, ordinal int, folder string, embedding array<float>"
#: Rows of a store that a task reads.
STORE_PART = 50_000


def _parts(spark: SparkSession, first: int, stop: int) -> DataFrame:
    """Rows (id): where each part of rows ``first`` to ``stop`` begins, a task each."""
    return spark.range(first, stop, STORE_PART, max(1, -(-(stop - first) // STORE_PART)))


def import_numpy(spark: SparkSession, matrix: str | None, metadata: str, identity: dict | None = None) -> DataFrame:
    """Vectors of an .npy matrix and their rows' {path, ordinal, folder}, in row order.

    ``metadata`` is a JSON list, or a commit file: an object with ``rows`` and an ``index_metadata`` that names
    the matrix beside it (``matrix`` is None then) and the vectors' identity. What ``identity`` gives must
    equal what it says. Tasks map ranges of the matrix; the driver sees its header alone.
    """
    import numpy as np

    whole = spark.read.text(metadata, wholetext=True)
    row = "array<struct<path:string,ordinal:int,folder:string>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", row)).otherwise(F.from_json("value", f"struct<rows:{row}>")["rows"])
    rows = whole.select(F.posexplode(listed).alias("row", "x")).select(F.col("row").cast("long").alias("row"), "x.path", F.coalesce("x.ordinal", F.lit(0)).alias("ordinal"), F.coalesce("x.folder", F.lit("")).alias("folder"))
    said = json.loads(whole.select(F.get_json_object("value", "$.index_metadata")).first()[0] or "{}")
    if wrong := sorted(k for k, v in (identity or {}).items() if said.get(k) != v):
        raise ValueError(f"the store's vectors were made in another way: {wrong}")
    if matrix is None:
        if not said.get("matrix") or os.path.basename(said["matrix"]) != said["matrix"]:
            raise ValueError("the commit file names no matrix beside it")
        matrix = os.path.join(os.path.dirname(metadata), said["matrix"])
    with open(matrix, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        offset = f.tell()
    if len(shape) != 2 or by_column or kind.kind != "f":
        raise ValueError("the matrix isn't rows of floating-point numbers")
    if shape[0] != rows.count() or said.get("dimension") not in (None, shape[1]):
        raise ValueError("the matrix and its metadata differ in length")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["id"]:
                stop = min(start + STORE_PART, shape[0])
                values = np.memmap(matrix, kind, "r", offset + start * shape[1] * kind.itemsize, (stop - start, shape[1]))
                for at in range(0, len(values), 1000):
                    part = values[at : at + 1000]
                    yield pd.DataFrame({"row": range(start + at, start + at + len(part)), "embedding": list(part.astype("f4"))})

    vectors = _parts(spark, 0, shape[0]).mapInPandas(read, "row long, embedding array<float>")
    return rows.join(vectors, "row").select("path", "ordinal", "folder", "embedding")


def import_sqlite(spark: SparkSession, database: str, table: str = "chunks", dimension: int | None = None) -> DataFrame:
    """Vectors stored as little-endian float32 blobs in columns path, ordinal, folder, vector; tasks read ranges of row ids.

    With a ``dimension`` the first vector of another one fails the job.
    """
    import sqlite3
    from contextlib import closing

    import numpy as np

    if not table.isidentifier():
        raise ValueError("not a table name")
    uri = f"file:{database}?mode=ro"
    with closing(sqlite3.connect(uri, uri=True)) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()  # noqa: S608
        if dimension is not None and db.execute(f"SELECT 1 FROM {table} WHERE length(vector) <> ? LIMIT 1", (4 * dimension,)).fetchone():  # noqa: S608
            raise ValueError("a vector has another dimension")
    if low is None:
        return spark.createDataFrame([], _VECTORS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["id"].tolist():
                with closing(sqlite3.connect(uri, uri=True)) as db:
                    found = db.execute(f"SELECT path, ordinal, folder, vector FROM {table} WHERE rowid >= ? AND rowid < ?", (start, min(start + STORE_PART, high + 1)))  # noqa: S608
                    while rows := found.fetchmany(1000):
                        yield pd.DataFrame([(p, o, f, np.frombuffer(v, dtype="<f4")) for p, o, f, v in rows], columns=["path", "ordinal", "folder", "embedding"])

    return _parts(spark, low, high + 1).mapInPandas(read, _VECTORS)


def import_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Vectors of a database with a JDBC driver on the class path; the vector as text ``[x,y,...]``.

    With Spark's own ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` tasks read ranges.
    """
    asked = {"dbtable": f"({query}) vectors"} if "partitionColumn" in options else {"query": query}
    rows = spark.read.format("jdbc").options(url=url, **asked, **options).load()
    return rows.withColumn("embedding", F.from_json("embedding", "array<float>"))


WriteHook = Callable[[str], None]
_BACKENDS: dict[tuple[str, str], Callable] = {}


def register_backend(family: str, name: str, factory: Callable) -> None:
    """A named factory of a family (store, embedding, summarizer, chunker)."""
    _BACKENDS[family, name] = factory


def backend(family: str, name: str) -> Callable:
    try:
        return _BACKENDS[family, name]
    except KeyError:
        raise LookupError(f"no {family} named {name!r}") from None


