"""Markdown in plain Python: front matter, headings, chunks, outlines, links and footnote marks."""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, time
from urllib.parse import unquote


class FrontMatterError(ValueError):
    pass


# --- front matter ---------------------------------------------------------------------------


def split_front_matter(text: str) -> tuple[dict, str]:
    """Metadata and body. A block is YAML between ``---``, TOML between ``+++``, or a JSON object before a blank line."""
    text = text.removeprefix("\ufeff")
    for mark, load in (("---", _yaml), ("+++", _toml)):
        m = re.match(rf"\s*{re.escape(mark)}[ \t]*\r?\n(.*?)(?:^|\n){re.escape(mark)}[ \t]*(?:\r?\n|\Z)", text, re.S)
        if m:
            return _mapping(load(m[1])), text[m.end() :].lstrip("\r\n")
    if text.lstrip().startswith("{"):
        try:
            data, end = json.JSONDecoder().raw_decode(text.lstrip())
        except ValueError:
            return {}, text
        rest = text.lstrip()[end:]
        if isinstance(data, dict) and (not rest or rest[0] in "\r\n"):
            return data, rest.lstrip("\r\n")
    return {}, text


def _yaml(block: str):
    import yaml

    try:
        if yaml.__with_libyaml__:
            try:
                return yaml.load(block, yaml.CSafeLoader)  # noqa: S506  as safe as SafeLoader, and several times as fast
            except (yaml.YAMLError, ValueError):
                pass  # the plain loader has the last word, and the message
        return yaml.safe_load(block)
    except (yaml.YAMLError, ValueError) as e:
        raise FrontMatterError(str(e).splitlines()[0]) from e


def _toml(block: str):
    import tomllib

    try:
        return tomllib.loads(block)
    except tomllib.TOMLDecodeError as e:
        raise FrontMatterError(str(e)) from e


def _mapping(data) -> dict:
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise FrontMatterError("the front matter is no mapping")
    return data


def plain(value):
    """Dates and times as ISO strings, at any depth; what JSON can't hold is refused."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date, time)):
        return value.isoformat()
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise FrontMatterError(f"a value of kind {type(value).__name__}")


def scalars(value) -> list[str]:
    """Distinct strings of a scalar or a list of scalars; mappings and nulls are skipped."""
    items = value if isinstance(value, list) else [value]
    return list(dict.fromkeys(str(plain(v)) for v in items if v is not None and not isinstance(v, (dict, list))))


# --- lines, headings, code ------------------------------------------------------------------

# Fences and headings.
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def open_lines(lines: list[str]) -> list[tuple[int, str]]:
    """Lines outside fenced code, with their numbers."""
    if not any("```" in line or "~~~" in line for line in lines):
        return list(enumerate(lines))
    out, fence = [], None
    for k, line in enumerate(lines):
        m = _FENCE.match(line.rstrip("\r\n"))
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        else:
            out.append((k, line))
    return out


def headings(body: str) -> list[tuple[int, str, int]]:
    """(level, text, line) of every ATX heading outside fences."""
    found = []
    if "#" not in body:
        return found
    for k, line in open_lines(body.splitlines(keepends=True)):
        if line[0] == "#" and (m := _HEADING.match(line.rstrip())):
            found.append((len(m[1]), m[2].strip(), k))
    return found


def mask_code(text: str) -> str:
    """Fenced blocks, code spans and comments as spaces; every other character keeps its place."""
    out = text
    if "```" in text or "~~~" in text:
        lines = text.splitlines(keepends=True)
        kept = dict(open_lines(lines))
        out = "".join(line if k in kept else re.sub(r"[^\r\n]", " ", line) for k, line in enumerate(lines))
    if "<!--" in out:
        out = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\r\n]", " ", m[0]), out, flags=re.S)
    if "`" not in out:
        return out
    pieces, at = [], 0
    for m in re.finditer(r"(?<!\\)(`+)", out):
        if m.start() < at:
            continue
        close = re.compile(rf"(?<!`){m[1]}(?!`)").search(out, m.end())
        if close and "\n\n" not in out[m.end() : close.start()]:
            pieces.append(out[at : m.start()] + re.sub(r"[^\r\n]", " ", out[m.start() : close.end()]))
            at = close.end()
    return "".join(pieces) + out[at:]


# --- chunks ---------------------------------------------------------------------------------


@dataclass
class Chunk:
    heading: str | None
    heading_level: int
    content: str
    start_line: int


@dataclass(frozen=True)
class _Span:
    """Lines first .. last of a body under a heading; ``at`` is the line that a chunk of it reports."""

    heading: str | None
    level: int
    at: int
    first: int
    last: int


def _blocks(text: str) -> list[tuple[int, str]]:
    """Runs of lines that aren't blank, with the number of the first line of each."""
    lines = text.splitlines(keepends=True)
    runs = itertools.groupby(enumerate(lines), key=lambda x: bool(x[1].strip()))
    return [(own[0][0], "".join(line for _, line in own)) for full, run in runs if full and (own := list(run))]


#: Ways to cut a text further, each with what joins its neighbours again: blocks, lines, words.
_CUTS = (
    (_blocks, "\n"),
    (lambda text: list(enumerate(text.splitlines(keepends=True))), ""),
    (lambda text: [(0, word) for word in text.split()], " "),
)


@dataclass(frozen=True)
class HeadingChunker:
    """Sections at headings of level 1 and 2, and deeper ones where a word or character budget asks for it.

    Documents of few lines stay whole. Without a budget nothing is cut further; with one, a section
    over it is cut at headings of the next level, and what has none at blocks, then lines, then words
    (a longer word stays whole). Overlap puts the last words of the fragment before, and an empty
    line, in front of a fragment, within one section.
    """

    short_lines: int = 30
    max_words: int | None = None
    max_chars: int | None = None
    overlap_words: int = 0

    def _size(self, text: str) -> tuple[int, int]:
        """Words, where they count, and characters."""
        return 0 if self.max_words is None else len(text.split()), len(text)

    def _within(self, words: int, chars: int) -> bool:
        return (self.max_words is None or words <= self.max_words) and (self.max_chars is None or chars <= self.max_chars)

    def _fits(self, text: str) -> bool:
        return self._within(*self._size(text))

    def chunk(self, body: str, metadata: dict | None = None) -> list[Chunk]:
        lines, marks = body.splitlines(keepends=True), headings(body)
        budgeted = self.max_words is not None or self.max_chars is not None
        whole = _Span(None, 0, 0, 0, len(lines))
        # the first row of levels that the body has at all; its deepest level is where a descent goes on
        rows = [(1, 2), *((n,) for n in range(3, 7) if budgeted)] if len(lines) > self.short_lines else []
        used = next((row for row in rows if any(level in row for level, _, _ in marks)), None)
        todo = [(part, used[-1]) for part in self._parts(whole, marks, used)] if used else [(whole, 6)]
        out: list[Chunk] = []
        todo.reverse()
        while todo:
            own, depth = todo.pop()
            text = "".join(lines[own.first : own.last])
            below = (depth + 1,)
            if used and not text.strip():
                continue
            if self._fits(text):
                out.append(Chunk(own.heading, own.level, text, own.at))
            elif own.heading is not None and any(level in below and own.first <= line < own.last for level, _, line in marks):
                todo += [(part, depth + 1) for part in reversed(self._parts(own, marks, below))]
            else:
                out += self._fragments(own, text)
        return out

    @staticmethod
    def _parts(own: _Span, marks: list[tuple[int, str, int]], levels: tuple[int, ...]) -> list[_Span]:
        """A span cut at headings of some levels; the lines before the first stay under the span's own heading."""
        inner = [m for m in marks if m[0] in levels and own.first <= m[2] < own.last]
        ends = [*(m[2] for m in inner[1:]), own.last]
        lead = _Span(own.heading, own.level, own.first, own.first, inner[0][2])
        return [lead, *(_Span(text, level, line, line + 1, end) for (level, text, line), end in zip(inner, ends, strict=True))]

    def _fragments(self, own: _Span, text: str) -> list[Chunk]:
        pieces = self._pieces(text, 0, 0) or [(0, text)]
        lead = [""] + [" ".join(piece.split()[-self.overlap_words :]) if self.overlap_words > 0 else "" for _, piece in pieces[:-1]]
        return [Chunk(own.heading, own.level, before + "\n\n" * bool(before) + piece, own.at + line) for before, (line, piece) in zip(lead, pieces, strict=True)]

    def _pieces(self, text: str, line: int, depth: int) -> list[tuple[int, str]]:
        """Neighbours joined while they fit; what doesn't fit alone is cut the next way.

        White space lies between neighbours, so that the words of both are those of each, and no text is counted twice.
        """
        out: list[tuple[int, list[str]]] = []
        cut, glue = _CUTS[depth]
        grows, words, chars = False, 0, 0
        for at, unit in cut(text):
            more, length = self._size(unit)
            if grows and self._within(words + more, chars + len(glue) + length):
                out[-1][1].append(unit)
                words, chars = words + more, chars + len(glue) + length
            elif grows := self._within(more, length) or depth + 1 == len(_CUTS):
                out.append((line + at, [unit]))
                words, chars = more, length
            else:
                out += [(first, [piece]) for first, piece in self._pieces(unit, line + at, depth + 1)]
        return [(first, glue.join(units)) for first, units in out]


class WholeDocumentChunker:
    def chunk(self, body: str, metadata: dict | None = None) -> list[Chunk]:
        return [Chunk(None, 0, body, 0)]


# --- outlines and titles --------------------------------------------------------------------


def title_of(metadata: dict, body: str, path: str, field: str | None = None) -> str:
    """The configured field, else title, else the first H1, else the file's stem."""
    for key in (field, "title"):
        value = metadata.get(key) if key else None
        if isinstance(value, (str, int, float)) and not isinstance(value, bool) and str(value).strip():
            return str(value).strip()
    first = next((text for level, text, _ in headings(body) if level == 1), None)
    return first or posixpath.splitext(posixpath.basename(path))[0]


def outline(title: str, found: list[tuple[int, str]], max_level: int = 6) -> list[tuple[int, str]]:
    """Headings in order under the title as H1; a real H1 that equals it is dropped."""
    rest = [(level, text) for level, text in found if level <= max_level and not (level == 1 and text == title)]
    return [(1, title), *rest]


def section(body: str, wanted: str) -> str | None:
    """From the first heading with that text (white space collapsed, case kept) to the next of its level or above."""
    key = " ".join(wanted.split())
    lines, own = body.splitlines(keepends=True), headings(body)
    for k, (level, text, line) in enumerate(own):
        if " ".join(text.split()) == key:
            end = next((at for lv, _, at in own[k + 1 :] if lv <= level), len(lines))
            return "".join(lines[line:end])
    return None


# --- links ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Link:
    target: str
    text: str
    kind: str  # markdown, wikilink, reference
    fragment: str | None
    raw: str
    start: int  # of the raw destination
    end: int


_DEFINITION = re.compile(r"^ {0,3}\[((?!\^)(?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$", re.M)
_WIKI = re.compile(r"(?<!\\)!?\[\[((?:[^\[\]\n|\\]|\\(?!\|))+)(?:\\?\|((?:(?!\]\]).)*))?\]\]")
_SCHEME = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)")
#: Characters of a reference's label at most.
LONGEST_LABEL = 999


def _label(text: str) -> str:
    return text.strip().lower()


def _line_kind(line: str) -> tuple[int, str]:
    """How deep a line is quoted, and what the rest is: blank, rule (also an underline), title, item or text."""
    at = depth = 0
    while True:
        indent = len(line) - at - len(line[at:].lstrip(" "))
        if indent > 3 or line[at + indent : at + indent + 1] != ">":
            break
        at, depth = at + indent + 1, depth + 1
        if line[at : at + 1] in (" ", "\t"):
            at += 1
    own = line[at:].strip(" \t")
    if not own:
        return depth, "blank"
    if indent > 3 or line[at + indent] == "\t":  # indented too far to be anything but text
        return depth, "text"
    signs = set(own) - {" ", "\t"}
    if len(signs) == 1 and (own.strip("=") == "" or own.strip("-") == "" or (signs <= set("*-_") and len(own) - own.count(" ") - own.count("\t") >= 3)):
        return depth, "rule"
    word = re.split("[ \t]", own, maxsplit=1)
    if word[0] in _HASHES:
        return depth, "title"
    if len(word) == 2 and (word[0] in ("-", "+", "*") or (word[0][-1] in ".)" and word[0][:-1].isdecimal() and len(word[0]) <= 10)):
        return depth, "item" if word[1].strip() else "text"
    return depth, "text"


_HASHES = tuple("#" * k for k in range(1, 7))


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Ranges inside which a link may lie: blank lines and rules end one, a heading is one, list items and deeper quotes begin one."""
    found: list[tuple[int, int]] = []
    begin = None  # of the paragraph that the line before was in
    at = above = 0
    for line in text.split("\n"):
        depth, kind = _line_kind(line)
        if begin is not None and (kind != "text" or depth > above):
            found.append((begin, at - 1))
            begin = None
        if kind == "title":
            found.append((at, at + len(line)))
        elif kind in ("text", "item") and begin is None:
            begin = at
        at, above = at + len(line) + 1, depth
    return found if begin is None else [*found, (begin, len(text))]


def _destination(raw: str) -> str | None:
    """Decoded destination: pointy form, escapes, entities, percent codes; None if it isn't a path in the vault."""
    raw = raw.strip()
    if raw.startswith("<") and raw.endswith(">"):
        raw = raw[1:-1]
    raw = html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", raw))
    if not raw or raw.startswith("#") or _SCHEME.match(raw) or re.search("%2f|%00", raw, re.I):
        return None
    return unquote(raw)


def relative(target: str, source: str) -> str:
    """Vault path of a destination: from the root if it starts with "/", else from the source's folder; ".." stops at the root."""
    parts = [] if target.startswith("/") else [p for p in posixpath.dirname(source).split("/") if p]
    for p in target.split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


_MARK = re.compile(r"\\.|!?\[|\]", re.S)


@dataclass
class _Opening:
    """A bracket that waits for its closing one."""

    place: int
    image: bool
    holds_link: bool = False


def _matches(part: str) -> dict[int, int]:
    """Each opening bracket's closing one, escaped ones aside, whatever they mean."""
    waiting, out = [], {}
    for m in _MARK.finditer(part):
        if m[0] == "]":
            if waiting:
                out[waiting.pop()] = m.start()
        elif m[0][-1] == "[" and m[0][0] != "\\":
            waiting.append(m.end() - 1)
    return out


def _innermost(part: str, target: Callable[[int, int], tuple | None]) -> list[tuple[int, int, tuple]]:
    """(open, close, target) of the brackets that make links, by place.

    ``target`` says what follows a pair of brackets, as a tuple that ends with where it stops, or None. A
    link holds no other link, at any depth; an image may hold links, and its own target is read over.
    """
    waiting: list[_Opening] = []
    found, skip = [], 0
    for m in _MARK.finditer(part):
        if m.start() < skip or m[0][0] == "\\":
            continue
        if m[0] != "]":
            waiting.append(_Opening(m.end() - 1, m[0] == "!["))
            continue
        if not waiting:
            continue
        own = waiting.pop()
        after = None if own.holds_link and not own.image else target(own.place, m.start())
        if after is not None:
            skip = after[-1]
            if not own.image:
                found.append((own.place, m.start(), after))
                own.holds_link = True
        if waiting:
            waiting[-1].holds_link |= own.holds_link
    return sorted(found)


def _inline_end(text: str, at: int) -> tuple[str, int, int] | None:
    """Raw destination, its start and the end of an inline target that opens at ``at``."""
    m = re.compile(r"\(\s*").match(text, at)
    if not m:
        return None
    start = pos = m.end()
    if text[pos : pos + 1] == "<":
        close = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(text, pos)
        if not close:
            return None
        pos = close.end()
    else:
        depth = 0
        while pos < len(text) and not text[pos].isspace():
            if text[pos] == "\\":
                pos += 1
            elif text[pos] == "(":
                depth += 1
            elif text[pos] == ")":
                if not depth:
                    break
                depth -= 1
            pos += 1
    tail = re.compile(r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)").match(text, pos)
    if tail:
        return text[start:pos], start, tail.end()
    # a name with blanks in it, up to the parenthesis that closes on the same line
    spaced = re.compile(r"((?:[^()<>\\\n]|\\.|\((?:[^()\\\n]|\\.)*\))+?)[ \t]*\)").match(text, start)
    return (spaced[1], start, spaced.end()) if spaced else None


def _defined_target(part: str, defined: dict[str, tuple[str, int]]) -> Callable[[int, int], tuple | None]:
    """What brackets without an inline target refer to: the label in brackets right after them, or else what they hold."""
    ends = _matches(part)

    def target(start: int, close: int) -> tuple | None:
        if _inline_end(part, close + 1) is not None:
            return None
        stop, label = close + 1, part[start + 1 : close]
        if (end := ends.get(close + 1)) is not None and end - close <= LONGEST_LABEL + 2:
            stop, label = end + 1, part[close + 2 : end].strip() or label
        meant = defined.get(_label(label))
        return None if meant is None else (*meant, stop)

    return target


def links(body: str, path: str, attachments: frozenset[str] = frozenset()) -> list[Link]:
    """Links to notes: first inline ones, then references (full, collapsed, shortcut), then wikilinks, each by place.

    Code, external targets, bare fragments, images and files that aren't notes are skipped, and no
    link reaches across paragraphs. An inline target goes before a reference. A label that is
    written but not defined makes no link, and no shortcut of the text before it either.
    """
    masked = mask_code(body)
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    defined: dict[str, tuple[str, int]] = {}
    text = masked
    if "]:" in masked:
        for m in _DEFINITION.finditer(masked):
            defined.setdefault(_label(m[1]), (m[2], m.start(2)))
        text = _DEFINITION.sub(blank, masked)
    wikis = list(_WIKI.finditer(text)) if "[[" in text else []
    open_text = _WIKI.sub(blank, text) if wikis else text
    found: list[Link] = []

    def add(kind: str, label: str, raw: str, start: int) -> None:
        wiki = kind == "wikilink"
        dest = raw if wiki else _destination(raw)
        if dest is None:
            return
        target, mark, fragment = dest.partition("#")
        target = target.strip() if wiki else target.partition("?")[0]
        suffix = posixpath.splitext(target)[1].lower()
        if not target or "\0" in target or (suffix and suffix != ".md" and (suffix[1:] in attachments or not wiki)):
            return
        full = target if wiki else relative(target, path)
        if not full.endswith(".md"):
            full += ".md"
        found.append(Link(full.lstrip("/"), " ".join(label.split()), kind, fragment if mark else None, raw, start, start + len(raw)))

    parts = [(base, part) for base, end in paragraphs(open_text) if "[" in (part := open_text[base:end])] if "[" in open_text else []
    for base, part in parts:
        for start, close, (raw, at, _) in _innermost(part, lambda _, close, part=part: _inline_end(part, close + 1)):
            add("markdown", text[base + start + 1 : base + close], raw, base + at)
    for base, part in parts:
        for start, close, (raw, at, _) in _innermost(part, _defined_target(part, defined)):
            add("reference", text[base + start + 1 : base + close], raw, at)
    for m in wikis:
        if not m[0].startswith("!"):
            add("wikilink", m[2] if m[2] is not None else m[1], m[1], m.start(1))
    return found


def splice(text: str, changes: list[tuple[int, int, str]]) -> str:
    """Replace ranges, last first, so that earlier places stay right."""
    for start, end, new in sorted(changes, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def rewrite_links(body: str, path: str, moved: dict[str, str], new_path: str | None = None) -> str:
    """Destinations of moved notes replaced, each in its own spelling (relative or from the root, with or without .md)."""
    own = new_path or path
    changes = {}
    for link in links(body, path):
        new = moved.get(link.target)
        if new is None:
            continue
        stem, mark, fragment = link.raw.strip("<>").partition("#")
        if link.kind == "wikilink":
            spelled = new if "/" in stem else posixpath.basename(new)
        elif stem.startswith("/"):
            spelled = "/" + new
        else:
            spelled = posixpath.relpath(new, posixpath.dirname(own) or ".")
            spelled = "./" + spelled if stem.startswith("./") and not spelled.startswith("../") else spelled
        if not stem.lower().endswith(".md"):
            spelled = spelled.removesuffix(".md")
        spelled += mark + fragment
        if link.raw.startswith("<"):
            spelled = f"<{spelled}>"
        elif link.kind != "wikilink":
            spelled = spelled.replace(" ", "%20")
        changes[link.start, link.end] = spelled
    return splice(body, [(a, b, new) for (a, b), new in changes.items()])


# --- citations ------------------------------------------------------------------------------

_MARKER = re.compile(r"(?<!\\)\[\^([^\]\s\[]+)\](?!:)")


def markers(body: str) -> dict[str, int]:
    """Footnote labels and how often each is used, outside code; definitions don't count."""
    counts: dict[str, int] = {}
    text = mask_code(body)
    text = text if "]:" not in text else re.sub(r"^ {0,3}\[\^[^\]\s]+\]:", lambda m: " " * len(m[0]), text, flags=re.M)
    for m in _MARKER.finditer(text):
        counts[m[1]] = counts.get(m[1], 0) + 1
    return counts


def _source_ids(sources) -> dict[str, list[int]]:
    """Places of the sources that have each non-empty id."""
    ids: dict[str, list[int]] = {}
    for k, source in enumerate(sources if isinstance(sources, list) else []):
        if isinstance(source, dict) and isinstance(source.get("id"), str) and source["id"]:
            ids.setdefault(source["id"], []).append(k)
    return ids


def _resource(source) -> str:
    value = source.get("resource") if isinstance(source, dict) else None
    return value if isinstance(value, str) and value.strip() else ""


def citations(metadata: dict, body: str) -> list[tuple[str, str, int, str]]:
    """(label, status, occurrences, resource) of a note with footnote marks and sources that name resources; else nothing.

    First every distinct resource, with label "" and status declared. Then every footnote label:
    matched, unmatched or ambiguous as one, no or several sources have it as id, and invalid_resource
    where the one that has it names none. Only matched labels carry a resource.
    """
    sources = metadata.get("sources")
    declared = dict.fromkeys(r for s in sources if (r := _resource(s))) if isinstance(sources, list) else {}
    if not declared or "[^" not in body:
        return []
    out = [("", "declared", 0, r) for r in declared]
    ids = _source_ids(sources)
    for label, n in markers(body).items():
        same = ids.get(label, [])
        resource = _resource(sources[same[0]]) if len(same) == 1 else ""
        status = "unmatched" if not same else "ambiguous" if len(same) > 1 else "matched" if resource else "invalid_resource"
        out.append((label, status, n, resource))
    return out


def inspect_citations(text: str) -> dict:
    """Sources and footnote labels of one whole text: joins, repeated ids, sources without an id, and flaws of ids."""
    plain_text = text.replace("\r\n", "\n").replace("\r", "\n")
    metadata, body = split_front_matter(plain_text)
    sources = metadata.get("sources")
    ids = _source_ids(sources)
    issues, unkeyed = [], []
    if "sources" in metadata and not isinstance(sources, list):
        issues.append("sources is not a list")
    for k, source in enumerate(sources if isinstance(sources, list) else []):
        if not isinstance(source, dict):
            issues.append(f"sources[{k}] is not a mapping")
        elif "id" not in source:
            unkeyed.append(k)
        elif not isinstance(source["id"], str) or not source["id"]:
            issues.append(f"sources[{k}].id is not a nonempty string")
    joined = []
    for label, n in markers(body).items():
        same = ids.get(label, [])
        joined.append({"id": label, "status": ("unmatched", "matched")[len(same)] if len(same) < 2 else "ambiguous", "occurrences": n, "source_indices": same})
    return {
        "returned_text_sha256": hashlib.sha256(plain_text.encode("utf-8", "surrogatepass")).hexdigest(),
        "sources": plain(sources),
        "citations": joined,
        "source_issues": issues,
        "duplicate_ids": [label for label, same in ids.items() if len(same) > 1],
        "unkeyed_source_indices": unkeyed,
    }


def wikilinks_to_markdown(body: str, path: str, resolved: dict[str, str]) -> tuple[str, int, int]:
    """Wikilinks with a known target as Markdown links, aliases kept; how many were converted and how many not."""
    changes, left = [], 0
    for m in _WIKI.finditer(mask_code(body)):
        stem, mark, fragment = body[m.start(1) : m.end(1)].partition("#")
        name = stem.strip() if stem.strip().endswith(".md") else stem.strip() + ".md"
        target = resolved.get(name)
        if m[0].startswith("!") or target is None:
            left += 1
            continue
        text = body[m.start(2) : m.end(2)] if m[2] is not None else stem.strip() + mark + fragment
        dest = posixpath.relpath(target, posixpath.dirname(path) or ".").replace(" ", "%20") + mark + fragment.replace(" ", "%20")
        changes.append((m.start(), m.end(), f"[{text}]({dest})"))
    return splice(body, changes), len(changes), left
