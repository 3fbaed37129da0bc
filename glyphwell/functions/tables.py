"""Ordered rewrite rules and word lists, kept as code points in resource files."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

_DATA = Path(__file__).parent / "data"


def _text(points: str) -> str:
    return "".join(chr(int(p, 16)) for p in points.split(".") if p)


@lru_cache
def rules(table: str) -> tuple[tuple[str, str], ...]:
    """The rules of ``pre``, ``main``, ``corrections`` or ``post``; their order matters."""
    rows = (line.split("\t") for line in (_DATA / "rules.tsv").read_text().splitlines())
    return tuple((_text(a), _text(b)) for name, a, b in rows if name == table)


@lru_cache
def words(kind: str) -> tuple[str, ...]:
    """The entries of ``stem``, ``marker``, ``guard``, ``font`` or ``unicode_font``, repeats included."""
    rows = (line.split("\t") for line in (_DATA / "words.tsv").read_text().splitlines())
    return tuple(_text(w) for name, w in rows if name == kind)
