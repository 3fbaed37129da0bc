"""Texts as lower-case words with single spaces between them, with the way back."""

from __future__ import annotations

import numpy as np

from glyphwell.llm import kernels


def fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case, and which of them belong to words."""
    low = kernels.LOWER[raw]
    inside = kernels.IS_WORD[raw]
    if len(raw) < 2 or raw.max() < 128:
        return low, inside
    lead, after = raw[:-1], raw[1:]
    at = np.flatnonzero((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)) + 1
    low[at] += 0x20
    for at in np.flatnonzero((lead == 0xC2) & (after >= 0xA0))[:, None] + np.arange(2), np.flatnonzero(((lead == 0xE2) & (after <= 0x81)) | ((lead == 0xE3) & (after == 0x80)))[:, None] + np.arange(3):
        inside[at.ravel()] = False
    return low, inside


class Normalised:
    """The rows of a slice as one text: a space before every word, and a space and a line feed after every row."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray) -> None:
        low, inside = fold(raw)
        open_ = np.empty(len(raw) + 2, bool)
        open_[0] = open_[-1] = False
        open_[1:-1] = inside
        begins = open_[1:-1] & ~open_[:-2]
        edge = starts[:-1][starts[:-1] < len(raw)]
        begins[edge] = inside[edge]
        ends = np.append(open_[1:-1] & ~open_[2:], False)
        edge = starts[1:][starts[1:] > 0]
        ends[edge - 1] |= inside[edge - 1]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(starts, self.first, side="right") - 1
        size = self.last - self.first
        before = np.cumsum(size + 1) - size - 1
        self.at = before + 2 * self.row
        out = np.full(int((size + 1).sum()) + 2 * (len(starts) - 1), 32, np.uint8)
        out[np.repeat(self.at + 1 - self.first, size) + np.flatnonzero(inside)] = low[inside]
        words = np.searchsorted(self.row, np.arange(len(starts) - 1), side="right")
        total = np.append(0, np.cumsum(size + 1))[words]
        out[total + 2 * np.arange(len(starts) - 1) + 1] = 10
        self.bytes = out
        #: Where each row begins, with the end last; a row's last two bytes close it.
        self.starts = np.append(0, np.cumsum(size + 1))[np.searchsorted(self.row, np.arange(len(starts)))] + 2 * np.arange(len(starts))

    def text(self) -> str:
        return self.bytes.tobytes().decode("utf-8", "replace")

    def byte_of_char(self) -> np.ndarray | None:
        """Where each character begins, or None if that is its own number."""
        return None if not len(self.bytes) or self.bytes.max() < 128 else np.flatnonzero((self.bytes & 0xC0) != 0x80)

    def origin(self, at: np.ndarray) -> np.ndarray:
        """The byte of the text as it was for places inside rows; a place before a word is the word's first byte."""
        word = np.searchsorted(self.at, at, side="right") - 1
        return np.minimum(self.first[word] + np.maximum(at - self.at[word] - 1, 0), self.last[word])
