"""Upkeep of a vault's metadata and generated pages: detection, stamps, reviews, indexes, logs; and jobs."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import okf as O
from ..model import DocumentFilter
from ..operators import history, population
from ..sources.vault import git_log
from .vault import Vault

_DAY = re.compile(r"^## (\d{4}-\d{2}-\d{2})[ \t]*$", re.M)


def detect(vault: Vault, mode: str = "auto") -> bool:
    """Whether maintained metadata is in force: on, off, or as the root index declares an okf_version."""
    if mode in ("on", "off"):
        return mode == "on"
    note = vault.load("index.md")
    return bool(note and str(note["frontmatter"].get("okf_version", "")).strip())


def _with_metadata(vault: Vault, path: str, change: Callable[[dict], dict]) -> str:
    import yaml

    note = vault.load(path)
    if note is None:
        raise FileNotFoundError(path)
    meta, body = M.split_front_matter(note["text"])
    block = yaml.safe_dump(M.plain(change(meta)), sort_keys=False, allow_unicode=True)
    return vault.write(path, f"---\n{block}---\n{body}", note["etag"])


def stamp(vault: Vault, path: str, actor: str, now: datetime | None = None) -> str:
    """Mark a note as generated by an actor; earlier reviews no longer apply."""
    return _with_metadata(vault, path, lambda m: O.stamp(m, actor, now or datetime.now(timezone.utc)))


def verify(vault: Vault, path: str, reviewer: str, now: datetime | None = None) -> str:
    return _with_metadata(vault, path, lambda m: O.verify(m, reviewer, now or datetime.now(timezone.utc)))


def convert_links(vault: Vault, folder: str | None = None, apply: bool = True) -> tuple[int, int]:
    """Wikilinks of a folder's notes as Markdown links; how many were converted and how many not."""
    from ..functions.patterns import folder_of, in_folder

    raw = vault.table("links").filter("link_type = 'wikilink'").select("source_path", "link_ordinal", F.col("target_path").alias("name"))
    live = population.live(vault.documents).select(F.col("path").alias("target_path"))
    known = vault.links.join(live, "target_path", "left_semi").select("source_path", "link_ordinal", "target_path")
    rows = raw.filter(in_folder(folder_of(F.col("source_path")), folder)).join(known, ["source_path", "link_ordinal"], "left")
    per_note = rows.groupBy("source_path").agg(F.collect_list(F.struct("name", "target_path")).alias("links"))
    done = left = 0
    for row in per_note.toLocalIterator():
        note = vault.load(row.source_path)
        text, n, rest = M.wikilinks_to_markdown(note["text"], row.source_path, {x.name: x.target_path for x in row.links if x.target_path})
        done, left = done + n, left + rest
        if apply and n:
            vault.write(row.source_path, text, note["etag"])
    return done, left


def build_indexes(vault: Vault, folder: str = "", only_missing: bool = True) -> list[str]:
    """Write index.md of a folder and all below: its notes by path, then its subfolders."""
    own = population.population(vault.documents, vault.table("tags"), DocumentFilter(folder=folder or None))
    grouped = own.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("path", "title"))).alias("notes"))
    found = {r.folder: [(n.path, n.title) for n in r.notes if not O.is_reserved(n.path)] for r in grouped.collect()}
    for at in list(found):  # folders without notes of their own still lead to others
        while at:
            at = at.rpartition("/")[0]
            found.setdefault(at, [])
    written = []
    for at, notes in sorted(found.items()):
        path = f"{at}/index.md" if at else "index.md"
        if (folder and at != folder and not at.startswith(folder + "/")) or (only_missing and vault.load(path)):
            continue
        below = sorted(f.rpartition("/")[2] for f in found if f and f.rpartition("/")[0] == at)
        vault.write(path, O.index_markdown(at.rpartition("/")[2] or "Index", notes, below))
        written.append(path)
    return written


def seed_log(vault: Vault, path: str = "log.md", limit: int | None = None) -> str:
    """Write a log from the repository's commits by day; an existing log is never overwritten."""
    if vault.load(path):
        raise FileExistsError(path)
    days = history.by_day(git_log(vault.spark, vault.root, limit)).collect()
    return vault.write(path, O.log_markdown([(d.day, [c.subject for c in d.commits]) for d in days]))


def append_log(vault: Vault, summary: str, path: str = "log.md", day: str | None = None) -> str:
    """Add an entry under today's heading, which is put first if it is new."""
    day = day or datetime.now(timezone.utc).strftime("%Y-%m-%d")
    note = vault.load(path)
    text = note["text"] if note else "# Log\n"
    at = re.search(rf"^## {day}[ \t]*$", text, re.M)
    if at:
        text = text[: at.end()] + f"\n\n- {summary}" + re.sub(r"^\n\n", "\n", text[at.end() :], count=1)
    else:
        first = _DAY.search(text)
        cut = first.start() if first else len(text)
        text = text[:cut].rstrip("\n") + f"\n\n## {day}\n\n- {summary}\n" + ("\n" + text[cut:] if first else "")
    return vault.write(path, text)


def repair_log(vault: Vault, path: str = "log.md", apply: bool = False) -> str:
    """The log with equal days merged, newest first; ``apply`` writes it and keeps the original beside it."""
    note = vault.load(path)
    if note is None:
        raise FileNotFoundError(path)
    parts = _DAY.split(note["text"])
    head, days = parts[0], {}
    for day, body in zip(parts[1::2], parts[2::2], strict=True):
        days.setdefault(day, []).extend(line for line in body.splitlines() if line.strip())
    text = head.rstrip("\n") + "\n" + "".join(f"\n## {d}\n\n" + "\n".join(dict.fromkeys(days[d])) + "\n" for d in sorted(days, reverse=True))
    if apply and text != note["text"]:
        vault.write(path.removesuffix(".md") + ".orig.md", note["text"])
        vault.write(path, text, note["etag"])
    return text


def maintain(vault: Vault, summary: str | None = None) -> dict[str, int]:
    """After writes: refresh what is dirty, write missing indexes, log the change, and refresh again."""
    counts = vault.flush()
    if detect(vault):
        build_indexes(vault)
        if summary:
            append_log(vault, summary)
        vault.flush()
    return counts


def embedding_status(vault: Vault) -> dict:
    """Counts of vectors and notes that have them, the dimension, and what search would use."""
    found = vault.store.manifest() or {"tables": []}
    if "vectors" not in found["tables"]:
        return {"vectors": 0, "notes": 0, "dimension": None, "mode": "keyword"}
    row = vault.table("vectors").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("path").alias("notes"), F.max(F.size("embedding")).alias("dimension")).first()
    return row.asDict() | {"mode": "hybrid" if vault.embed else "keyword"}


@dataclass
class Jobs:
    """Long work on driver threads: start gives an id, status tells working, completed, failed or cancelled until its time is over."""

    ttl: float = 3600.0
    known: dict[str, dict] = field(default_factory=dict)

    def start(self, vault: Vault, work: Callable[[], object]) -> str:
        name, context = uuid.uuid4().hex, vault.spark.sparkContext
        job = self.known[name] = {"state": "working", "until": time.time() + self.ttl, "result": None}

        def run() -> None:
            try:
                context.setJobGroup(name, "notelake job", True)
                result = work()
            except Exception as e:  # noqa: BLE001  any failure is the job's outcome
                state, result = "failed", f"{type(e).__name__}: {e}"
            else:
                state = "completed"
            if job["state"] == "working":
                job.update(state=state, result=result)

        job["thread"] = threading.Thread(target=run, daemon=True)
        job["thread"].start()
        return name

    def status(self, name: str) -> dict:
        for key in [k for k, j in self.known.items() if j["until"] < time.time()]:
            del self.known[key]
        job = self.known[name]
        return {"state": job["state"], "result": job["result"]}

    def cancel(self, vault: Vault, name: str) -> None:
        if self.known[name]["state"] == "working":
            self.known[name]["state"] = "cancelled"
            vault.spark.sparkContext.cancelJobGroup(name)
