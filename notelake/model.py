"""Schemas of the derived tables, and the requests that queries take."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

DOCUMENTS = schema(
    path=S, path_folded=S, title=S, folder=S, frontmatter_json=S, frontmatter=MapType(S, ArrayType(S)),
    content_hash=S, modified_at=D, size=L, chunk_count=I, content_chars=L, skip_category=S, skip_detail=S,
)
SECTIONS = schema(path=S, ordinal=I, heading=S, heading_level=I, content=S, start_line=I)
HEADINGS = schema(path=S, position=I, heading=S, heading_level=I)
TAGS = schema(path=S, tag_key=S, tag_value=S)
ALIASES = schema(path=S, alias=S)
CITATIONS = schema(path=S, label=S, status=S, occurrences=I, resource=S)
LINKS = schema(source_path=S, link_ordinal=I, target_path=S, link_text=S, link_type=S, fragment=S, raw_target=S)
POSTINGS = schema(term=S, path=S, ordinal=I, col=S, tf=I, positions=ArrayType(I), dl=L)
LENGTHS = schema(path=S, ordinal=I, dl=L)
VECTORS = schema(path=S, ordinal=I, folder=S, embedding=ArrayType(FloatType()))
COMMITS = schema(sha=S, author=S, committed_at=D, subject=S, paths=ArrayType(S))

SCOPES = {"metadata": ("path", "title", "heading", "summary"), "body": ("content",), "all": ("path", "title", "folder", "heading", "content", "summary")}
MAX_PAGE, MAX_OFFSET = 1000, 2**31 - 1 - 1000
# an instant needs its offset; minutes of the offset are checked too
_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)")


class InvalidRequest(ValueError):
    """A request that no query can answer."""


def parse_instant(text: str) -> float:
    """Seconds since the epoch of an RFC 3339 instant; anything else is refused."""
    if not _INSTANT.fullmatch(text):
        raise InvalidRequest(f"not an instant with an offset: {text!r}")
    try:
        return datetime.fromisoformat(text.upper().replace("Z", "+00:00")).timestamp()
    except ValueError as e:
        raise InvalidRequest(f"not an instant: {text!r}") from e


def _clean(name: str, value: str | None) -> None:
    if value is not None and "\0" in value:
        raise InvalidRequest(f"{name} holds a NUL character")


def normal_folder(folder: str | None) -> str | None:
    """Backslashes become slashes, outer slashes go; None stays (no restriction), "" is the root."""
    return None if folder is None else folder.replace("\\", "/").strip("/")


@dataclass(frozen=True)
class DocumentFilter:
    """Restrictions of an exact query; all must hold."""

    query: str | None = None
    scope: str = "all"
    path: str | None = None
    folder: str | None = None
    path_glob: str | None = None
    path_prefix: str | None = None
    path_contains: str | None = None
    tags: tuple[tuple[str, str], ...] = ()
    modified_from: float | None = None
    modified_to: float | None = None
    type: str | None = None
    status: str | None = None
    stale: bool | None = None
    trust_tier: str | None = None
    indexed_keys: frozenset[str] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        for name in ("query", "path", "folder", "path_glob", "path_prefix", "path_contains"):
            _clean(name, getattr(self, name))
        if self.scope not in SCOPES:
            raise InvalidRequest(f"unknown scope {self.scope!r}")
        if self.indexed_keys is not None and (unknown := {k for k, _ in self.tags} - self.indexed_keys):
            raise InvalidRequest(f"fields that aren't indexed: {sorted(unknown)}")
        for name in ("type", "status", "trust_tier"):
            _clean(name, getattr(self, name))
        if None not in (self.modified_from, self.modified_to) and self.modified_from > self.modified_to:
            raise InvalidRequest("modified_from is after modified_to")


    @property
    def derived(self) -> list[tuple[str, str]]:
        """Restrictions on maintained metadata, as column and value."""
        own = {k: getattr(self, k) for k in ("type", "status", "stale", "trust_tier")}
        return [(k, str(v).lower() if isinstance(v, bool) else v) for k, v in own.items() if v is not None]


def check_page(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= MAX_PAGE:
        raise InvalidRequest(f"limit must be 1 to {MAX_PAGE}")
    if offset < 0:
        raise InvalidRequest("offset must not be negative")
    return limit, min(offset, MAX_OFFSET)
