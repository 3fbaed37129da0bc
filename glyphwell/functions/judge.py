"""Lines and words judged one text at a time: what an executor needs beside a document or a file.

A document is judged by itself, so a corpus needs no shuffle: only words with a
sign of the legacy range are tried at first, and others only near one that proved
to be legacy. The column expressions of ``functions.text`` and ``operators.classify``
state the same rules over tables of words and lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import regex

from glyphwell.functions import kernel as K, tables, text as X

CONTEXT = 6
#: Words that a judge remembers.
_MEMORY = 200_000
_SEGMENT = re.compile(f"[{K._SPACES}]+|[^{K._SPACES}]+")  # in half the time of the same in ``regex``
_WORD, _ANY_LETTER, _TOKEN_EDGES = re.compile(f"[^{K._SPACES}]+"), re.compile("[A-Za-z]"), re.compile(r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+\Z")
_LINE = regex.compile(r"[\t\n]|[^\t\n]+")
_LETTER, _ALPHABETIC = regex.compile(r"[\p{Alphabetic}\p{N}]"), regex.compile(r"\p{Alphabetic}")
_BENGALI, _BIJOY, _SIGNAL = (re.compile(f"[{c}]") for c in (X.BENGALI, X.BIJOY, X.SIGNAL))
_SPACE_OR_DIGIT, _VISIBLE = re.compile(f"[{X.SPACE}0-9]+"), re.compile(f"[\x21-\x7e{X.SIGNAL}]")
_IS_SPACE, _LETTERS = re.compile(f"[{X.SPACE}]"), re.compile("[A-Za-z]{2,}")
_NOT_BASE = re.compile(f"[^{''.join(sorted(K._BASE))}]+")
_ROMAN, _SCRIPTS = regex.compile(r"\(*[ivxlcdmIVXLCDM]{1,4}[).:]"), regex.compile(f"[{X.SCRIPTS}]")
_ILL_FORMED = re.compile("|".join(X._FAULTS))
_EDGES = regex.compile(f"^[^{X.BENGALI}]+|[^{X.BENGALI}]+$")
_OPENING = regex.compile(f"(?:^|(?<=[{X.SPACE}]))[{X.KAR}{X.HALANT}]")
_MISPLACED = regex.compile(f"(?<=[{X.KAR}])[{X.KAR}]|(?<={X.HALANT})[{X.KAR}]|(?<=[{X.KAR}]){X.HALANT}")
_NEVER_FIRST, _TYPOGRAPHY = frozenset(map(chr, (0x99E, 0x982, 0x983, 0x981, 0x9CE, 0x9DC, 0x9DD, 0x9DF))), frozenset("‘’“”–—…•")
_AT_LEAST = 12


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(text)


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def in_context(found: dict[int, bool]) -> set[int]:
    """By place in order, words that are legacy alone (true) or uncertain (false): the places of those that are legacy, alone or within six of one that is."""
    sure = [k for k, legacy in found.items() if legacy]
    return {k for k, legacy in found.items() if legacy or ((at := bisect_left(sure, k - CONTEXT)) < len(sure) and sure[at] <= k + CONTEXT)} if sure else set()


def token_label(token: str, font: str | None) -> str:
    """``text.token_label`` of one token."""
    key = token, font
    if (found := _labels.get(key)) is None:
        if len(_labels) >= _MEMORY:
            _labels.clear()
        found = _labels[key] = _token_label(token, font)
    return found


_labels: dict[tuple[str, str | None], str] = {}


def _token_label(token: str, font: str | None) -> str:
    letter = bool(_ANY_LETTER.search(token))
    if not token.isascii() and _BENGALI.search(token):
        return "unicode"
    if font is None and letter:
        return "unknown_font"
    if font is not None and K.legacy_font(font):
        if not any(name in font.lower() for name in ("sutonnymj", "sutonnyemj")):
            return "other_legacy"
        return "legacy" if _BIJOY.search(token) else "legacy_ascii"
    if not token.isascii() and _BIJOY.search(_TOKEN_EDGES.sub("", token)):
        return "font_disputed"
    return "english" if letter else "inert"


def lines(text: str) -> list[str]:
    return _LINE.findall(text)


def bones(text: str) -> str:
    """The consonants of a text, sorted: conversion moves and drops marks, but neither adds nor drops a consonant once the tables have run."""
    return "".join(sorted(_NOT_BASE.sub("", K.decompose_nukta(text))))


class Judge:
    """Verdicts of words by two word lists, and the conversion of texts by them."""

    def __init__(self, bengali: frozenset[str], english: frozenset[str]) -> None:
        self.bengali, self.english = bengali, english
        self._known: dict[str, tuple[str, str | None]] = {}
        self._tried: dict[str, bool] = {}
        self._bones = frozenset(map(bones, bengali))

    def __getstate__(self) -> dict:
        return {"bengali": self.bengali, "english": self.english, "_known": {}, "_tried": {}, "_bones": self._bones}

    def _is_english(self, word: str) -> bool:
        core = word.rstrip("‘’“”–—")
        if core != word and sum(c.isascii() and c.isalpha() for c in core) < 4:
            return False
        if not core.isascii():
            return False
        bare = regex.sub("^[^a-z]+|[^a-z]+$", "", core.lower())
        return len(bare) >= 2 and bare in self.english

    def alone(self, word: str) -> tuple[str, str | None]:
        """The first rule that decides a word by itself, and its conversion if it was tried."""
        if (found := self._known.get(word)) is None:
            if len(self._known) >= _MEMORY:
                self._known.clear()
            found = self._known[word] = self._alone(word)
        return found

    def rules(self, words: list[str]) -> list[str]:
        """The first rule that decides each word by itself; those not known yet are converted together."""
        own = [w for w in dict.fromkeys(words) if w not in self._known]
        now: dict[str, str] = {}
        stops = {w: self._stop(w) for w in own}
        tried = [w for w, stop in stops.items() if stop is None]
        now.update((w, stop) for w, stop in stops.items() if stop is not None)
        made = dict(zip(tried, K.convert_all(tried)))
        now.update((w, self._rule(w, made[w])) for w in tried)
        out = [now[w] if w in now else self._known[w][0] for w in words]
        if len(self._known) + len(own) > _MEMORY:
            self._known.clear()
        self._known.update((w, (rule, made.get(w))) for w, rule in now.items())
        return out

    def may_be_legacy(self, words: list[str]) -> list[bool]:
        """Of words with a sign of the legacy range, without converting them: whether they can be legacy alone, as all are that have two signs and one in ten, or the consonants of an entry."""
        out = [len(exotic) >= 2 and len(exotic) * 10 >= len(word) and len(set(exotic)) >= 2 for word in words for exotic in (_BIJOY.findall(word),)]
        rest = [k for k, dense in enumerate(out) if not dense]
        made = [words[k] for k in rest]
        for table in ("pre", "main", "corrections"):
            made = K.apply_all(made, table)
        for k, folded in zip(rest, made):
            out[k] = bones(folded) in self._bones
        return out

    def _try(self, words: list[str]) -> None:
        """``may_be_legacy`` of words that weren't asked for yet."""
        own = [w for w in dict.fromkeys(words) if w not in self._tried]
        if len(self._tried) + len(own) > _MEMORY:
            self._tried.clear()
            own = list(dict.fromkeys(words))
        self._tried.update(zip(own, self.may_be_legacy(own)))

    def _alone(self, word: str) -> tuple[str, str | None]:
        if (stop := self._stop(word)) is not None:
            return stop, None
        made = K.convert(word)
        return self._rule(word, made), made

    def _stop(self, word: str) -> str | None:
        if _BENGALI.search(word) or not (_LETTER.search(word) or _BIJOY.search(word)):
            return "hard_stop_unicode_or_inert"
        if self._is_english(word):
            return "hard_stop_english"
        if _ROMAN.fullmatch(word):
            return "hard_stop_roman_numeral_marker"
        if _SCRIPTS.search(word):
            return "hard_stop_sub_or_superscript"
        return "hard_stop_lone_conjunct_glyph" if word in ("¹", "²", "³") else None

    def _rule(self, word: str, made: str) -> str:
        """The rule of a word without a hard stop, by its conversion."""
        exotic = _BIJOY.findall(word)
        entry = K.compose_vowels(K.compose_nukta(_EDGES.sub("", made)))
        listed = entry != "" and entry in self.bengali
        if listed and exotic:
            return "legacy_byte_and_dictionary"
        first = _BENGALI.search(made)
        plausible = bool(exotic) and not _ILL_FORMED.search(made) and not (first and first.group() in _NEVER_FIRST)
        if len(exotic) * 10 >= len(word) and len(set(exotic)) >= 2 and plausible:
            return "legacy_density"
        if listed and len(_LETTER.findall(word)) >= 2:
            return "uncertain_dictionary_word"
        if plausible:
            return "uncertain_plausible"
        return "alphanumeric_floor" if listed else "not_a_dictionary_word_and_not_plausible"

    def _legacy(self, words: list[str]) -> dict[int, str]:
        """By place, the conversion of each word that is legacy, or is uncertain within six words of one that is."""
        exotic = [k for k, word in enumerate(words) if not word.isascii() and _BIJOY.search(word)]
        if not exotic:
            return {}
        if any(words[k] not in self._tried for k in exotic):
            self._try([words[k] for k in exotic])
        if unknown := [words[k] for k in exotic if self._tried[words[k]] and words[k] not in self._known]:
            self.rules(unknown)
        out: dict[int, str] = {}
        sure = []
        for k in exotic:
            if self._tried[words[k]] and (found := self.alone(words[k]))[0].startswith("legacy"):
                out[k] = found[1]
                sure.append(k)
        near, done = [], 0
        for k in sure:
            near += [at for at in range(max(done, k - CONTEXT), min(k + CONTEXT + 1, len(words))) if at not in out]
            done = k + CONTEXT + 1
        for at, rule in zip(near, self.rules([words[at] for at in near])):
            if rule.startswith("uncertain"):
                out[at] = self.alone(words[at])[1]
        return out

    def legacy(self, words: list[str]) -> list[str | None]:
        """``_legacy`` as a list with None for words that stay."""
        found = self._legacy(words)
        return [found.get(k) for k in range(len(words))]

    def judged(self, text: str) -> tuple[list[str], int, dict[int, str], dict[int, str]]:
        """The segments, of which every second one from a number on is a word; by place, what legacy words become, and other words whose two-part vowels are composed."""
        parts = segments(text)
        first = 1 if parts and _IS_SPACE.match(parts[0]) else 0
        changed = {first + 2 * k: made for k, made in self._legacy(parts[first::2]).items()}
        composed: dict[int, str] = {}
        if "\u09c7" in text:
            composed = {k: made for k in range(first, len(parts), 2) if k not in changed and (made := K.compose_vowels(parts[k])) != parts[k]}
        return parts, first, changed, composed

    def pieces(self, text: str) -> list[tuple[str, str, bool, bool]]:
        """Segment, what it becomes, whether that is a conversion, and whether it is a word."""
        parts, first, changed, composed = self.judged(text)
        out = [(s, s, False, (k - first) % 2 == 0) for k, s in enumerate(parts)]
        for found, is_changed in ((composed, False), (changed, True)):
            for k, made in found.items():
                out[k] = (parts[k], made, is_changed, True)
        return out

    def convert(self, text: str) -> tuple[str, int, int]:
        """The text with its legacy words in Unicode, and how many words were converted and how many not."""
        parts, first, changed, composed = self.judged(text)
        for found in (changed, composed):
            for k, made in found.items():
                parts[k] = made
        return "".join(parts), len(changed), len(range(first, len(parts), 2)) - len(changed)


# ---- lines


def reads_as_english(text: str) -> bool:
    markers, hits = _markers(), 0
    for word in _LETTERS.findall(text):
        hits += word.lower() in markers
    return hits >= 2


@lru_cache
def _markers() -> frozenset[str]:
    return frozenset(tables.words("marker"))


def typography_only(text: str) -> bool:
    seen = [c for c in text if _SIGNAL.match(c) and not _IS_SPACE.match(c)]
    return bool(seen) and all(c in _TYPOGRAPHY for c in seen)


def plausible(text: str) -> bool:
    """Fewer than one mark in 25 Bengali characters is misplaced; always so for fewer than 8."""
    n = len(_BENGALI.findall(text))
    return n < 8 or (len(_OPENING.findall(text)) + len(_MISPLACED.findall(text))) * 25 < n


def stem_hits(text: str) -> int:
    folded = K.decompose_nukta(text)
    return sum(stem in folded for stem in K._stems())


def makes_bengali(line: str, strict: bool) -> bool:
    """Whether a line's conversion reads as Bengali."""
    if _BENGALI.search(line) or not _ALPHABETIC.search(line):
        return False
    return _reads(K.convert(line), strict)


def _reads(trial: str, strict: bool) -> bool:
    hits = stem_hits(trial)
    return (hits >= 2 and hits * 60 >= len(_BENGALI.findall(trial)) if strict else hits >= 1) and plausible(trial)


def detect(text: str) -> tuple[str, float, float, float]:
    """Encoding of a line, confidence, and the shares of Bengali and of the legacy range."""
    seen = _SPACE_OR_DIGIT.sub("", text)
    n = len(seen)
    if not n:
        return "not_bangla", 1.0, 0.0, 0.0
    bengali, visible = len(_BENGALI.findall(seen)), len(_VISIBLE.findall(seen))
    if bengali * 100 > n * 15:
        return "unicode", bengali / n, bengali / n, visible / n
    exotic = [c for c in _SIGNAL.findall(text) if not _IS_SPACE.match(c)]
    english = reads_as_english(text)
    dense = len(exotic) * 10 >= n and len(set(exotic)) >= 2 and not english and not typography_only(text)
    if bengali * 50 < n and (dense or (not english and makes_bengali(text, True))):
        return "legacy", min(1.0, len(exotic) / n * 5), bengali / n, visible / n
    return "not_bangla", 1 - len(exotic) / n, bengali / n, visible / n


def detect_all(texts: list[str]) -> list[tuple[str, float, float, float]]:
    """``detect`` of each line, as the columns have it: shares in single precision, and none but one of no characters for nothing. The trial conversions run together."""
    seen = [_SPACE_OR_DIGIT.sub("", t) for t in texts]
    ascii_ = [t.isascii() for t in texts]
    counts = [(len(s), 0 if a else len(_BENGALI.findall(s)), len(_VISIBLE.findall(s)), [] if a else [c for c in _SIGNAL.findall(s)]) for s, a in zip(seen, ascii_)]
    verdicts: list[str | None] = []
    for t, (n, bengali, _, exotic) in zip(texts, counts):
        if not n:
            verdicts.append("not_bangla")
        elif bengali * 100 > n * 15:
            verdicts.append("unicode")
        elif bengali * 50 >= n or reads_as_english(t):
            verdicts.append("not_bangla")
        elif len(exotic) * 10 >= n and len(set(exotic)) >= 2 and not typography_only(t):
            verdicts.append("legacy")
        else:
            verdicts.append("not_bangla" if bengali or not _ALPHABETIC.search(t) else None)
    tried = [k for k, v in enumerate(verdicts) if v is None]
    for k, trial in zip(tried, K.convert_all([texts[k] for k in tried])):
        verdicts[k] = "legacy" if _reads(trial, True) else "not_bangla"
    out, one = [], np.float32(1)
    for verdict, (n, bengali, visible, exotic) in zip(verdicts, counts):
        if not n:
            out.append((verdict, 1.0, 0.0, 0.0))
            continue
        ratio, share, range_ = np.float32(bengali / n), np.float32(len(exotic) / n), np.float32(visible / n)
        sure = ratio if verdict == "unicode" else min(one, share * np.float32(5)) if verdict == "legacy" else one - share
        out.append((verdict, float(sure), float(ratio), float(range_)))
    return out


def looks_legacy(line: str) -> bool:
    """Whether a fragment may be legacy in a document that has legacy text: by its conversion, or one sign in ten."""
    if reads_as_english(line):
        return False
    if makes_bengali(line, False):
        return True
    seen = _IS_SPACE.sub("", line)
    return bool(seen) and len(_SIGNAL.findall(seen)) * 10 >= len(seen)


def convert_by_lines(text: str) -> tuple[str, int, int, str]:
    """A document converted line by line, its lines and separators, how many were converted, and what most are.

    A line of under twelve visible characters is converted only in a document with
    a legacy line, if it looks legacy, and, as plain ASCII, reads as Bengali.
    """
    parts = lines(text)
    verdicts: list[str | None] = []
    for line in parts:
        if not _LETTER.search(line):
            verdicts.append("unicode")
        else:
            verdicts.append(None if len(_IS_SPACE.sub("", line)) < _AT_LEAST else "?")
    long = [k for k, v in enumerate(verdicts) if v == "?"]
    for k, found in zip(long, detect_all([parts[k] for k in long])):
        verdicts[k] = found[0]
    legacy, unicode_ = verdicts.count("legacy"), verdicts.count("unicode")
    out, converted = [], 0
    for line, verdict in zip(parts, verdicts):
        if line in "\n\t":
            out.append(line)
        elif verdict == "legacy" or (verdict is None and legacy and looks_legacy(line) and (not line.isascii() or K.reads_as_bengali(K.convert(line)))):
            out.append(K.convert(line))
            converted += 1
        else:
            out.append(line if verdict is None else K.repair_unicode(line))
    dominant = "legacy" if legacy and legacy >= unicode_ else "unicode" if unicode_ else "not_bangla"
    return "".join(out), len(parts), converted, dominant
