"""Path patterns as anchored Java regular expressions, and case folding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _translate(pattern: str, negation: str) -> str:
    """``*`` and ``?`` cross slashes; a class that isn't closed is literal; ``negation`` inverts a class."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 1 + (pattern[at : at + 1] == negation))) > 0:
            body = pattern[at:end]
            inverted, body = body[:1] == negation, body.removeprefix(negation)
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body)
            out.append(f"[{'^' if inverted else ''}{body}]")
            at = end + 1
        else:
            out.append(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", c))
    return "(?s)^" + "".join(out) + r"\z"


def glob_regex(pattern: str) -> str:
    """Of exact queries: case-sensitive, ``[^...]`` inverts."""
    return _translate(pattern, "^")


def fnmatch_regex(pattern: str) -> str:
    """Of listings and excludes: case-sensitive, ``[!...]`` inverts."""
    return _translate(pattern, "!")


def in_folder(folder_col: Column, folder: str | None) -> Column:
    """A folder and all below it; "" is the root alone; None restricts nothing."""
    if folder is None:
        return F.lit(True)
    folder = folder.replace("\\", "/").strip("/")
    return folder_col == "" if not folder else (folder_col == folder) | folder_col.startswith(folder + "/")


def folder_of(path: Column) -> Column:
    """Parent path, "" at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem_of(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def basename_of(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")
