"""The reordering state machine and the reverse encoder, for distinct words in Arrow batches.

What native expressions can't state: marks move across clusters whose length
depends on what precedes. Everything here works on single strings and is applied
to distinct values only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, functions as F

from glyphwell.functions import tables

RA, HALANT, BINDU = "র", "্", "ঁ"
PRE = frozenset("িেৈ")
POST = frozenset("াোৌৗুূীৃ")
KAR = PRE | POST
_BASE = frozenset([*map(chr, range(0x995, 0x9A9)), *map(chr, range(0x9AA, 0x9B1)), "ল", *map(chr, range(0x9B6, 0x9BA)), *"ৎড়ঢ়য়"])
CONSONANT = _BASE | frozenset("ঁংঃ")
JOINERS = frozenset("‌‍")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE = frozenset(_SPACES)
_JOIN = re.compile(f"([{''.join(sorted(_BASE))}]) ([{''.join(sorted(KAR))}{HALANT}])")
_DOUBLE = re.compile(f"([{''.join(sorted(KAR))}{HALANT}])\\1+")
_WORDS = re.compile(f"[^{_SPACES}]*[{_SPACES}]|[^{_SPACES}]+")
_PAIR = re.compile(f"[{''.join(sorted(KAR))}]{{2}}")
_MOVES = frozenset([RA, HALANT, BINDU, *PRE])
_MOVED = re.compile(f"[{HALANT}{BINDU}{''.join(sorted(PRE))}]")
#: Between the texts of a batch: in no rule, and texts that have it are worked out one by one.
_APART = "\ue000"
#: Characters of texts that are rewritten together.
_TOGETHER = 1 << 17


def single_halants(s: str) -> list[str]:
    """Doubled halants become one, but for those around a reph's neighbour."""
    if HALANT + HALANT not in s:
        return list(s)
    out, i, n = [], 0, len(s)
    while i < n:
        if s[i] == HALANT and s[i + 1 : i + 2] == HALANT:
            out.append(HALANT)
            reph = i >= 2 and s[i - 1] == RA and (s[i - 2] in CONSONANT or s[i - 2] in KAR) and s[i + 2 : i + 3] and s[i + 2] in CONSONANT
            i += 1 if reph else 2
        else:
            out.append(s[i])
            i += 1
    return out


def _reph_target(at: Callable[[int], str], i: int) -> int:
    """How far before ``i`` a reph moves, or 0 if it doesn't."""
    j = 1
    while j <= i:
        c = at(i - j)
        if c in CONSONANT and j < i and at(i - j - 1) == HALANT:
            j += 2
        elif j == 1 and c in KAR:
            j += 1
        else:
            return j
    return 0


def rearrange(s: str) -> str:
    """Visual order to logical order."""
    if not _MOVED.search(s):
        return s  # nothing below moves anything else
    t, i = single_halants(s), 0

    def at(k: int) -> str:
        return t[k] if 0 <= k < len(t) else "\0"

    while i < len(t):
        if t[i] not in _MOVES:
            i += 1
            continue
        if t[i] == RA and at(i + 1) == HALANT and i > 0 and at(i - 1) != HALANT and (at(i - 1) in CONSONANT or at(i - 1) in KAR):
            if j := _reph_target(at, i):
                t[i - j : i + 2] = t[i : i + 2] + t[i - j : i]
                i += 2
                continue
        if i > 0 and i + 1 < len(t) and t[i] == HALANT and (at(i - 1) in KAR or at(i - 1) == BINDU):
            t[i - 1], t[i], t[i + 1] = t[i], t[i + 1], t[i - 1]
        if i > 0 and i + 1 < len(t) and t[i] == HALANT and at(i - 1) == RA and not (i >= 2 and at(i - 2) == HALANT) and at(i + 1) in KAR:
            t[i - 1], t[i], t[i + 1] = t[i + 1], t[i - 1], t[i]
        if t[i] in PRE and at(i + 1) in JOINERS:
            k = i + 1
            while at(k) in JOINERS:
                k += 1
            if at(k) in CONSONANT:
                t[i:k] = t[i + 1 : k] + [t[i]]
                i = k - 1
        if i + 1 < len(t) and t[i] in PRE and at(i + 1) not in _SPACE:
            j = 1
            while i + j < len(t) - 1 and at(i + j) in CONSONANT:
                if at(i + j + 1) != HALANT:
                    break
                j += 2
            stop, sign, extra = min(i + j + 1, len(t)), t[i], 0
            if sign == "ে" and at(i + j + 1) in ("া", "ৗ"):
                sign, extra = "ো" if at(i + j + 1) == "া" else "ৌ", 1
            t[i : i + j + 1 + extra] = [*t[i + 1 : stop], sign]  # in place: a new list at every sign would be quadratic
            i += j
        if at(i) == BINDU and at(i + 1) in POST:
            t[i], t[i + 1] = t[i + 1], t[i]
        i += 1
    return "".join(t)


_NUKTA = (("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়"))


def compose_nukta(s: str) -> str:
    for two, one in _NUKTA:
        s = s.replace(two, one)
    return s


def decompose_nukta(s: str) -> str:
    for two, one in _NUKTA:
        s = s.replace(one, two)
    return s


@lru_cache
def _stems() -> tuple[str, ...]:
    return tuple(decompose_nukta(s) for s in tables.words("stem") if len(s) >= 3)


def stem_hits_all(texts: list[str]) -> list[int]:
    """How many stems, repeats counted, each text contains; a stem is searched for once in all texts joined."""
    out: list[int] = []
    for some in together(texts):
        folded = [decompose_nukta(t) for t in some]
        starts = list(accumulate((len(t) + 1 for t in folded), initial=0))
        joined, hits = _APART.join(folded), [0] * len(folded)
        for stem in _stems():
            at = joined.find(stem)
            while at >= 0:
                k = bisect_right(starts, at) - 1
                hits[k] += 1
                at = joined.find(stem, starts[k + 1])
        out += hits
    return out


def reads_as_bengali(s: str) -> bool:
    s = decompose_nukta(s)
    return any(stem in s for stem in _stems())


def repair_word(word: str) -> tuple[str, bool]:
    """A word whose first pair of adjacent vowel signs lost one, and whether that was a guess."""
    if found := _PAIR.search(word):
        k = found.start()
        first, second = word[:k] + word[k + 1 :], word[: k + 1] + word[k + 2 :]
        a, b = reads_as_bengali(first), reads_as_bengali(second)
        if a != b:
            return (first if a else second), False
        return (first if word[k] in PRE else second), True
    return word, False


def compose_vowels(s: str) -> str:
    return s.replace("ো", "ো").replace("ৌ", "ৌ")


def mend(s: str) -> tuple[str, int]:
    """Vowel composition with the repairs that every conversion runs, and the number of guesses."""
    s, guesses = _DOUBLE.sub(r"\1", compose_vowels(s)), 0
    if _PAIR.search(s):
        parts = [repair_word(w) for w in _WORDS.findall(s)]
        s, guesses = "".join(p for p, _ in parts), sum(g for _, g in parts)
    return _JOIN.sub(r"\1\2 ", s), guesses


def _apply(s: str, table: str) -> str:
    for a, b in tables.rules(table):
        if a in s:
            s = s.replace(a, b)
    return s


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of a bounded number of characters, one text at least."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > _TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield some


def apply_all(texts: list[str], table: str) -> list[str]:
    """A table's rules on each text. A rule is searched for once in all of them joined, not once a text."""
    out: list[str] = []
    for some in together(texts):
        joined = _APART.join(some)
        if joined.count(_APART) == len(some) - 1:
            out += _apply(joined, table).split(_APART)
        else:
            out += [_apply(t, table) for t in some]
    return out


def normalise_spaces(s: str) -> str:
    return (re.sub(" +", " ", s) if "  " in s else s).replace(" \n", "\n").replace("\n ", "\n")


def convert_counted(s: str) -> tuple[str, int]:
    """Legacy text to Unicode, and the number of guessed vowel signs."""
    s = normalise_spaces(s)
    for table in ("pre", "main", "corrections"):
        s = _apply(s, table)
    s, guesses = mend(rearrange(s))
    return _apply(s, "post"), guesses


def convert_all_counted(texts: list[str]) -> list[tuple[str, int]]:
    """``convert_counted`` of each text."""
    out: list[tuple[str, int]] = []
    for some in together(texts):
        made = [normalise_spaces(t) for t in some]
        for table in ("pre", "main", "corrections"):
            made = apply_all(made, table)
        mended = [mend(rearrange(t)) for t in made]
        out += zip(apply_all([t for t, _ in mended], "post"), (guesses for _, guesses in mended))
    return out


def convert_all(texts: list[str]) -> list[str]:
    return [t for t, _ in convert_all_counted(texts)]


def convert(s: str) -> str:
    return convert_counted(s)[0]


def repair_unicode(s: str) -> str:
    """Repairs run on Unicode text until nothing changes, eight rounds at most."""
    if not any("ঀ" <= c <= "৿" for c in s):
        return s
    for _ in range(8):
        after = mend(_JOIN.sub(r"\1\2 ", s))[0]
        if after == s:
            break
        s = after
    return s


@lru_cache
def reverse_table() -> dict[str, list[tuple[str, str]]]:
    """By first character: what the main table yields, the longest first, with the first glyph that yields it."""
    first: dict[str, str] = {}
    for glyph, value in tables.rules("main"):
        if value and not value.isascii():
            first.setdefault(value, glyph)
    out: dict[str, list[tuple[str, str]]] = {}
    for value, glyph in first.items():
        out.setdefault(value[0], []).append((value, glyph))
    return {c: sorted(entries, key=lambda e: -len(e[0])) for c, entries in out.items()}


_HALVES = {k: (k, "") for k in PRE} | {"ো": ("ে", "া"), "ৌ": ("ে", "ৗ")}


def visual_order(s: str) -> str:
    """Logical order to visual order, a syllable at a time."""
    out, i, n = [], 0, len(s)
    while i < n:
        reph = s[i] == RA and i + 2 < n and s[i + 1] == HALANT and s[i + 2] in CONSONANT and (i == 0 or s[i - 1] != HALANT)
        start = i + 2 if reph else i
        if s[start] not in CONSONANT:
            out.append(s[i])
            i += 1
            continue
        end = start + 1
        while end + 1 < n and s[end] == HALANT and s[end + 1] in CONSONANT:
            end += 2
        kar = s[end] if end < n and s[end] in KAR else ""
        before, after = _HALVES.get(kar, ("", kar))
        out += [before, s[start:end], RA + HALANT if reph else "", after]
        i = end + len(kar)
    return "".join(out)


def to_legacy(s: str) -> str:
    """Unicode text in the legacy encoding; what has no glyph stays."""
    s, out, i = visual_order(compose_nukta(s)), [], 0
    table = reverse_table()
    while i < len(s):
        for value, glyph in table.get(s[i], ()):
            if s.startswith(value, i):
                out.append(glyph)
                i += len(value)
                break
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def difference(a: str, b: str) -> str:
    """Where two words differ, without what they share at either end."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    m = 0
    while m < min(len(a), len(b)) - k and a[-1 - m] == b[-1 - m]:
        m += 1
    clip = lambda s: "(nothing)" if not s else s if len(s) <= 12 else s[:12] + "…"
    return f"{clip(a[k : len(a) - m])} → {clip(b[k : len(b) - m])}"


def legacy_font(name: str) -> bool:
    low = name.lower()
    return not low.startswith("+") and not any(f in low for f in tables.words("unicode_font")) and any(f in low for f in tables.words("font"))


_HOLES = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_CP1252 = "".join("�" if k in _HOLES else bytes([k]).decode("cp1252") for k in range(256))


_BACK = {ord(c): k for k, c in enumerate(_CP1252) if c != "�"}
_LATIN = {k: c for k, c in enumerate(_CP1252)}


def from_windows_1252(data: bytes) -> str:
    return data.decode("latin-1").translate(_LATIN)


def to_windows_1252(text: str) -> bytes:
    return bytes(_BACK.get(ord(c), 63) for c in text)


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding of bytes: UTF-8 if they are valid, else Windows-1252."""
    try:
        return data.decode("utf-8").removeprefix("﻿"), "utf-8"
    except UnicodeDecodeError:
        return from_windows_1252(data), "windows-1252"


def column(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """``f`` over a string column in Arrow batches, once for each distinct value of a batch."""
    return column_of_all(lambda values: [f(v) for v in values])


def stem_hits_column(text: Column | str) -> Column:
    """``stem_hits_all`` of a string column; null stays null."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        distinct = list(values.dropna().unique())
        known = dict(zip(distinct, stem_hits_all(distinct)))
        return pd.Series([known.get(v) for v in values], dtype="Int32")

    return run(text)


def column_of_all(f: Callable[[list[str]], list[str]]) -> Callable[[Column | str], Column]:
    """The same of an ``f`` that takes all distinct values of a batch at once.

    It counts as not deterministic, so that Spark works it out once, where it
    stands: a filter on its result would else be moved before a ``distinct`` or
    an aggregation, and run it again for every row there.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        distinct = list(values.dropna().unique())
        known = dict(zip(distinct, f(distinct)))
        return pd.Series([known.get(v) for v in values], dtype=object)

    return run.asNondeterministic()
