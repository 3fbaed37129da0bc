"""Golden conversions, repairs and encodings."""

import pytest

from glyphwell.functions import kernel as K, tables

GOLDEN = {"Awd†mi bvgt": "অফিসের নামঃ", "Kg©m~wP": "কর্মসূচি", "eª¨vÛ": "ব্র্যান্ড", "wi‡cvU©": "রিপোর্ট", "c`‡ÿc": "পদক্ষেপ", "¯^vÿi": "স্বাক্ষর", "c~e©eZ©x": "পূর্ববর্তী", "Avw_©K": "আর্থিক", "m‡e©v”P": "সর্বোচ্চ", "mvwe©K": "সার্বিক", "wbe©vPb": "নির্বাচন", "j²x": "লক্ষ্মী", "¶è": "ক্ষ্ণ", "¤œ": "ম্ন", "•¶": "ঙ্ক্ষ", "D‡jøL¨": "উল্লেখ্য", "mswkøó": "সংশ্লিষ্ট", "iæwUb": "রুটিন", "k¦K": "শ্বক", "k©¦K": "র্শ্বক", "": ""}


@pytest.mark.parametrize("legacy,expected", GOLDEN.items())
def test_convert(legacy, expected):
    assert K.compose_nukta(K.convert(legacy)) == K.compose_nukta(expected)


@pytest.mark.parametrize("text,legacy", {"অফিসের নামঃ": "Awd†mi bvgt", "কর্মসূচি": "Kg©m~wP", "আমি": "Avwg", "তু": "Zy", "ল্ল": "j¬", "কে": "†K"}.items())
def test_to_legacy(text, legacy):
    assert K.to_legacy(text) == legacy and K.convert(legacy) == text


@pytest.mark.parametrize("text,fixed", {"অনিুযায়ী": "অনুযায়ী", "নারীাদের": "নারীদের", "ঝিুঝ": "ঝুঝ"}.items())
def test_repair_word(text, fixed):
    assert K.repair_word(text)[0] == fixed


def test_tables():
    assert [len(tables.rules(t)) for t in ("pre", "main", "corrections", "post")] == [15, 191, 1, 17]
    assert len(tables.words("stem")) == 162 and len(set(tables.words("marker"))) == 85 and len(tables.words("guard")) == 163 and len(tables.words("font")) == 27


def test_round_trip_of_stems():
    wrong = [w for w in set(tables.words("stem")) if K.compose_nukta(K.convert(K.to_legacy(w))) != K.compose_vowels(K.compose_nukta(w))]
    assert not wrong


def test_bytes():
    every = bytes(range(0x80, 0x100))
    text = K.from_windows_1252(every)
    assert len(text) == 128 and text.count("�") == 5
    assert K.to_windows_1252(K.from_windows_1252(b"a\xe9\x80")) == b"a\xe9\x80" and K.to_windows_1252("ক") == b"?"
    assert K.decode(b"\xef\xbb\xbfa") == ("a", "utf-8") and K.decode(b"\xe9") == ("é", "windows-1252")


def test_difference():
    assert K.difference("abcd", "abxd") == "c → x" and K.difference("ab", "ab") == "(nothing) → (nothing)"
