"""Tokens, stems, snippets and text matching, in plain Python; and their bulk forms."""

from __future__ import annotations

import difflib
import re
import unicodedata

_RUN = re.compile(r"[^\W_]+")


def fold(token: str) -> str:
    """Case and diacritics removed."""
    if token.isascii():
        return token.lower()
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Runs of letters and numbers, folded."""
    return [fold(t) for t in _RUN.findall(text)]


def count_words(text: str) -> int:
    return len(_RUN.findall(text))


# --- Porter's algorithm, as published in 1980 -----------------------------------------------

_VOWELS = frozenset("aeiou")
# The suffix tables of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_ENDS2, _ENDS3 = tuple(s for s, _ in _STEP2), tuple(s for s, _ in _STEP3)
_LONGEST4 = tuple(sorted(_STEP4, key=len, reverse=True))


def _shape(word: str) -> str:
    """v or c per letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in _VOWELS or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, table: tuple) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """Stem of a folded token; tokens with other letters than a-z, and short ones, stay."""
    if not 2 < len(word) < 64 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (cut := 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0) and "v" in _shape(word[:-cut]):
        word = word[:-cut]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # most words have none of the suffixes, which one call tells
    word = _swap(word, _STEP2) if word.endswith(_ENDS2) else word
    word = _swap(word, _STEP3) if word.endswith(_ENDS3) else word
    for suffix in _LONGEST4 if word.endswith(_LONGEST4) else ():
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


#: Tokens whose terms are remembered, after which all are forgotten, and their length, at most.
MOST_KNOWN, LONGEST_KNOWN = 1 << 16, 64


class Stems(dict):
    """Terms by token as it is written: each is folded and stemmed once, as few tokens make most of any text."""

    def __missing__(self, token: str) -> str:
        found = stem(fold(token))
        if len(token) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[token] = found
        return found


def terms(text: str, known: Stems | None = None) -> list[str]:
    """Index terms: folded tokens, stemmed; ``known`` is kept from text to text."""
    known = Stems() if known is None else known
    return [known[t] for t in _RUN.findall(text)]


# --- snippets and matching ------------------------------------------------------------------


def snippet(text: str, query_terms: set[str], n: int) -> str:
    """The window of n words with most query terms, the leftmost of equals; n = 0 gives all."""
    own = text.split()
    if n <= 0 or len(own) <= n:
        return text.strip()
    hits = [any(t in query_terms for t in terms(w)) for w in own]
    total = best = sum(hits[:n])
    at = 0
    for k in range(1, len(own) - n + 1):
        total += hits[k + n - 1] - hits[k - 1]
        if total > best:
            best, at = total, k
    return ("… " if at else "") + " ".join(own[at : at + n]) + (" …" if at + n < len(own) else "")


# Characters that match as one.
_SAME = str.maketrans("\u2013\u2014\u201c\u201d\u2018\u2019", "--\"\"''")


def normal_form(text: str) -> tuple[str, list[int]]:
    """NFC, dashes and quotes as ASCII, blanks of a line as one and none at its end; and each character's place in ``text``."""
    out: list[str] = []
    places: list[int] = []

    def end_line() -> None:
        while out and out[-1] != "\n" and out[-1].isspace():
            out.pop()
            places.pop()

    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        for c in unicodedata.normalize("NFC", text[at:end]).translate(_SAME):
            if c in " \t":
                if out and out[-1] == " ":
                    continue
                c = " "
            elif c == "\n":
                end_line()
            out.append(c)
            places.append(at)
        at = end
    end_line()
    return "".join(out), places


def find_normal(text: str, wanted: str) -> list[tuple[int, int]]:
    """Places (start, end) in ``text`` where ``wanted`` occurs in normal form."""
    own, places = normal_form(text)
    key = normal_form(wanted)[0].strip()
    found, at = [], own.find(key) if key else -1
    while at >= 0:
        end = places[at + len(key)] if at + len(key) < len(places) else len(text)
        if own[at + len(key) - 1] != " ":
            last = places[at + len(key) - 1]
            end = last + len(text[last:end].rstrip()) if text[last:end].strip() else end
        found.append((places[at], end))
        at = own.find(key, at + len(key))
    return found


def closest(text: str, wanted: str, least: float = 0.6) -> dict | None:
    """Where ``wanted`` nearly occurs: the line most like its first line, and the first line that differs."""
    own, lines = text.splitlines(), wanted.splitlines()
    if not own or not lines:
        return None
    ratios = [difflib.SequenceMatcher(None, line, lines[0]).ratio() for line in own]
    best = max(range(len(own)), key=ratios.__getitem__)
    if ratios[best] < least:
        return None
    for k, line in enumerate(lines):
        found = own[best + k] if best + k < len(own) else None
        if found != line:
            return {"line": best + k + 1, "expected": line, "found": found, "ratio": ratios[best]}
    return {"line": best + 1, "expected": lines[0], "found": own[best], "ratio": ratios[best]}
