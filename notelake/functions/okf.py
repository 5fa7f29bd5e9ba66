"""Maintained-metadata derivations of a note: status, staleness, trust, evidence, audit findings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

RESERVED = ("index.md", "log.md")
ROOT_INDEX = "index.md"
# Statuses, tiers, the shape of an actor, the characters an audit reads, and its findings.
STATUSES = ("draft", "stable", "deprecated")
UNVERIFIED, MACHINE, HUMAN = "unverified", "machine-confirmed", "human-reviewed"
ACTOR = re.compile(r"(?:(?:human|process):\S(?:[ \S]*\S)?|[^\s/:]+/[^\s/]+)")
AUDIT_CHARS = 65536
RULES = (
    "missing_type", "unparseable_frontmatter", "misplaced_okf_version", "unknown_status", "log_heading_shape", "wikilink_files", "missing_recommended",
    "index_frontmatter", "malformed_sources", "malformed_generated", "missing_freshness", "malformed_freshness", "malformed_review", "evidence_unavailable",
)


def is_reserved(path: str) -> bool:
    return path.rpartition("/")[2] in RESERVED


def _instant(value) -> datetime | None:
    """An instant with an offset; anything else is None."""
    if isinstance(value, datetime):
        return value if value.tzinfo else None
    if isinstance(value, str) and re.match(r"\d{4}-\d{2}-\d{2}[Tt ]", value):
        try:
            parsed = datetime.fromisoformat(value.strip().replace("Z", "+00:00").replace("z", "+00:00"))
        except ValueError:
            return None
        return parsed if parsed.tzinfo else None
    return None


def expiry(value) -> date | datetime | None:
    """A day or an instant with an offset."""
    if isinstance(value, datetime) or (isinstance(value, str) and len(value.strip()) > 10):
        return _instant(value)
    if isinstance(value, date):
        return value
    if isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
        try:
            return date.fromisoformat(value.strip())
        except ValueError:
            return None
    return None


def is_stale(metadata: dict, now: datetime) -> bool:
    """Whether now has reached stale_after: a day by now's own calendar, an instant exactly; naive times don't count."""
    at = expiry(metadata.get("stale_after"))
    if at is None:
        return False
    return now >= at if isinstance(at, datetime) else now.date() >= at


def _actor(value) -> bool:
    return isinstance(value, str) and ACTOR.fullmatch(value.strip()) is not None


def verified_entries(metadata: dict) -> list:
    value = metadata.get("verified")
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _reviewed(entry) -> bool:
    return isinstance(entry, dict) and _actor(entry.get("by")) and _instant(entry.get("at")) is not None


def trust_tier(metadata: dict) -> str:
    """The best tier among well-formed reviews: one by a human beats those by machines; without any it is unverified."""
    by = [e["by"].strip() for e in verified_entries(metadata) if _reviewed(e)]
    if any(b.startswith("human:") for b in by):
        return HUMAN
    return MACHINE if by else UNVERIFIED


def _evidence(metadata: dict, key: str, entries: list, usable: Callable[[object], bool]) -> dict:
    """State of one kind of evidence, with how many entries can and can't be used."""
    if key not in metadata:
        return {"state": "missing", "recorded_entries": 0, "malformed_entries": 0}
    if not entries:  # an empty list is no flaw, any other value that gives no entry is one
        empty = isinstance(metadata[key], list)
        return {"state": "empty" if empty else "malformed", "recorded_entries": 0, "malformed_entries": int(not empty)}
    good = sum(map(usable, entries))
    return {"state": "recorded" if good else "malformed", "recorded_entries": good, "malformed_entries": len(entries) - good}


def annotate(metadata: dict, now: datetime) -> dict:
    """type, status (stable by default), stale, trust_tier, and the state of each kind of evidence."""
    text = {k: v.strip() for k, v in metadata.items() if isinstance(v, str) and v.strip()}
    sources = metadata.get("sources")
    source_list = sources if isinstance(sources, list) else []
    made = metadata.get("generated")
    well_made = isinstance(made, dict) and _actor(made.get("by")) and ("at" not in made or _instant(made["at"]) is not None)
    fresh = "missing" if "stale_after" not in metadata else "malformed" if expiry(metadata["stale_after"]) is None else "expired" if is_stale(metadata, now) else "unexpired"
    return {
        "type": text.get("type"),
        "status": text.get("status", "stable"),
        "stale": is_stale(metadata, now),
        "trust_tier": trust_tier(metadata),
        "freshness": fresh,
        "review": _evidence(metadata, "verified", verified_entries(metadata), _reviewed),
        "attribution": _evidence(metadata, "sources", source_list, lambda e: isinstance(e, dict) and "resource" in e),
        "generation": "missing" if made is None and "generated" not in metadata else "recorded" if well_made else "malformed",
        "sources_count": len(source_list),
    }


def parse_stale(value: str) -> bool:
    spelled = value.strip().lower()
    if spelled not in ("true", "1", "yes", "false", "0", "no"):
        raise ValueError(f"stale is true or false, not {value!r}")
    return spelled in ("true", "1", "yes")


def matches(annotation: dict, wanted: dict[str, str]) -> bool:
    """Whether a note's status, staleness and tier are the wanted ones."""
    for key, value in wanted.items():
        own = annotation["stale"] == parse_stale(value) if key == "stale" else annotation.get(key) == value
        if not own:
            return False
    return True


@dataclass(frozen=True)
class _Page:
    path: str
    metadata: dict
    body: str
    has_block: bool
    derived: dict


_DAY_HEADING = re.compile(r"## \d{4}-\d{2}-\d{2}\s*")
# What each rule of RULES looks for, by the kind of page that answers for it.
_ALWAYS: dict[str, Callable[[_Page], bool]] = {"misplaced_okf_version": lambda p: "okf_version" in p.metadata and p.path != ROOT_INDEX}
_NAVIGATION: dict[str, Callable[[_Page], bool]] = {
    "log_heading_shape": lambda p: p.path.endswith("log.md") and any(x.startswith("## ") and not _DAY_HEADING.fullmatch(x) for x in p.body.splitlines()),
    "index_frontmatter": lambda p: p.path.endswith("index.md") and p.has_block and not (p.path == ROOT_INDEX and set(p.metadata) == {"okf_version"}),
}
_UNREAD: dict[str, Callable[[_Page], bool]] = {"unparseable_frontmatter": lambda p: True, "evidence_unavailable": lambda p: True}
_CONTENT: dict[str, Callable[[_Page], bool]] = {
    "missing_type": lambda p: p.derived["type"] is None,
    "unknown_status": lambda p: isinstance(p.metadata.get("status"), str) and p.metadata["status"].strip() not in ("", *STATUSES),
    "wikilink_files": lambda p: "[[" in p.body,
    "missing_recommended": lambda p: not (p.metadata.get("title") and p.metadata.get("description")),
}
_EVIDENCE: dict[str, Callable[[_Page], bool]] = {
    "missing_freshness": lambda p: p.derived["freshness"] == "missing",
    "malformed_freshness": lambda p: p.derived["freshness"] == "malformed",
    "malformed_review": lambda p: p.derived["review"]["malformed_entries"] > 0,
    "malformed_sources": lambda p: p.derived["attribution"]["malformed_entries"] > 0,
    "malformed_generated": lambda p: p.derived["generation"] == "malformed",
}


def findings(path: str, metadata: dict | None, body: str, has_block: bool = True, now: datetime | None = None, most: int | None = AUDIT_CHARS) -> list[str]:
    """The rules of RULES that a note breaks, in their order; ``metadata`` is None where its block can't be parsed.

    Pages that only navigate answer for their shape alone. Evidence isn't judged for notes that can't
    be parsed or are over the audited length ``most`` (None: any length is audited), which is a finding itself.
    """
    if is_reserved(path):
        asked = _NAVIGATION
    elif metadata is None:
        asked = _UNREAD
    else:
        asked = _CONTENT | ({"evidence_unavailable": lambda p: True} if most is not None and len(body) > most else _EVIDENCE)
    page = _Page(path, metadata or {}, body, has_block, annotate(metadata or {}, now or datetime.now(timezone.utc)))
    return [rule for rule in RULES if (test := (_ALWAYS | asked).get(rule)) and test(page)]



def index_markdown(title: str, notes: list[tuple[str, str]], folders: list[str]) -> str:
    """An index page: a folder's notes as (path, title), then pointers to its subfolders."""
    lines = [f"# {title}", ""]
    lines += [f"- [{name}]({path.rpartition('/')[2].replace(' ', '%20')})" for path, name in notes]
    lines += [f"- [{f}/]({f.replace(' ', '%20')}/index.md)" for f in folders]
    return "\n".join(lines) + "\n"


def log_markdown(days: list[tuple[str, list[str]]]) -> str:
    """A log page: newest day first, a line for each entry."""
    lines = ["# Log", ""]
    for day, entries in days:
        lines += [f"## {day}", "", *(f"- {e}" for e in entries), ""]
    return "\n".join(lines)


def stamp(metadata: dict, actor: str, now: datetime) -> dict:
    """Metadata after a write: generated by the actor now, earlier reviews gone."""
    return {k: v for k, v in metadata.items() if k != "verified"} | {"generated": {"by": actor, "at": now.isoformat()}}


def verify(metadata: dict, reviewer: str, now: datetime) -> dict:
    """Metadata with one more review."""
    return metadata | {"verified": [*verified_entries(metadata), {"by": reviewer, "at": now.isoformat()}]}
