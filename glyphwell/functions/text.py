"""Character classes and string operators as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphwell.functions import kernel, tables

#: Unicode White_Space, spelled out: the regex class ``\s`` differs between engines.
SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"
BENGALI = r"ঀ-৿"
HALANT = r"্"
PRE_KAR = r"িেৈ"
KAR = r"া-ৃেৈোৌৗ"
CONSONANT = r"ক-নপ-রলশ-হৎঁ-ঃড়ঢ়য়"
BASE = r"ক-নপ-রলশ-হৎড়ঢ়য়"
VOWEL = r"অ-ঌএঐওঔ"
#: Characters that the legacy encoding draws as Bengali; a word's own range has no sub- and superscripts.
SIGNAL = r" -ɏ‐-⃿"
BIJOY = r" -ɏ‐-⁯₠-⃿"
TYPOGRAPHY = r"‘’“”–—…•"
SCRIPTS = r"⁰-₟"

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(text: C) -> Column:
    """Alternating runs of words and gaps; joined they are the text again."""
    return F.regexp_extract_all(_c(text), F.lit(f"([{SPACE}]+|[^{SPACE}]+)"), 1)


def words(text: C) -> Column:
    """The maximal runs without whitespace, in order."""
    # As one pass by character and a split at single spaces: a regex of this class takes ten times as long.
    return F.array_remove(F.split(F.translate(_c(text), kernel._SPACES, " " * len(kernel._SPACES)), " "), "")


def lines(text: C) -> Column:
    """Lines and cells; each line feed and tab is a piece of its own."""
    return F.regexp_extract_all(_c(text), F.lit(r"([\t\n]|[^\t\n]+)"), 1)


def count_of(text: C, members: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(_c(text), f"[^{members}]", ""))


def normalise_spaces(text: C) -> Column:
    """One space for each run of them, and none beside a line feed."""
    one = F.regexp_replace(_c(text), " +", " ")
    return F.replace(F.replace(one, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))


def fold(text: C, table: str) -> Column:
    """Every rule of a table in turn, each on what the last one left; over a batch of texts at once."""
    return kernel.column_of_all(lambda values: kernel.apply_all(values, table))(_c(text))


def _each(text: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


NUKTA = (("ড়", "ড়"), ("ঢ়", "ঢ়"), ("য়", "য়"))
TWO_PART = (("ো", "ো"), ("ৌ", "ৌ"))


def compose_nukta(text: C) -> Column:
    return _each(_c(text), *NUKTA)


def decompose_nukta(text: C) -> Column:
    return _each(_c(text), *((b, a) for a, b in NUKTA))


def compose_vowels(text: C) -> Column:
    """The two-part vowel signs as single characters."""
    return _each(_c(text), *TWO_PART)


def canonical(text: C) -> Column:
    return compose_vowels(compose_nukta(text))


def collapse_doubles(text: C) -> Column:
    """A vowel sign or halant that follows its equal goes."""
    return F.regexp_replace(_c(text), f"([{KAR}{HALANT}])\\1+", "$1")


def reunite(text: C) -> Column:
    """A vowel sign that a space parts from its consonant joins it; the space follows."""
    return F.regexp_replace(_c(text), f"([{BASE}]) ([{KAR}{HALANT}])", "$1$2 ")


def typography_only(text: C) -> Column:
    """Every signal character is one that word processors insert by themselves, and there is one."""
    seen = F.regexp_replace(F.regexp_replace(_c(text), f"[{SPACE}]", ""), f"[^{SIGNAL}]", "")
    return (seen != "") & (F.regexp_replace(seen, f"[{TYPOGRAPHY}]", "") == "")


def two_distinct(text: C, members: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(f"([{members}])"), 1))) >= 2


def reads_as_english(text: C) -> Column:
    """Two or more function words, repeats counted."""
    markers = sorted(set(tables.words("marker")))
    return F.size(F.filter(F.split(_c(text), "[^A-Za-z]+"), lambda w: (F.length(w) >= 2) & F.lower(w).isin(markers))) >= 2


_FAULTS = (f"^[^{BENGALI}]*[{KAR}{HALANT}]", f"[{KAR}][{KAR}]", f"{HALANT}[{KAR}]", f"[{KAR}]{HALANT}", f"[{VOWEL}][{KAR}]")


def well_formed(text: C) -> Column:
    """No mark opens the Bengali of a word or stands where none can."""
    return ~_c(text).rlike("|".join(_FAULTS))


def faults(text: C) -> Column:
    """Marks where none can stand: at a word's beginning, or after a mark that they can't follow."""
    text = _c(text)
    opening = f"(?:^|(?<=[{SPACE}]))[{KAR}{HALANT}]"
    return F.regexp_count(text, F.lit(opening)) + F.regexp_count(text, F.lit(f"(?<=[{KAR}])[{KAR}]|(?<={HALANT})[{KAR}]|(?<=[{KAR}]){HALANT}"))


def plausible(text: C) -> Column:
    """Fewer than one mark in 25 Bengali characters is misplaced; always so for fewer than 8."""
    bengali = count_of(text, BENGALI)
    return (bengali < 8) | (faults(text) * 25 < bengali)


def roman_marker(word: C) -> Column:
    return _c(word).rlike(r"^\(*[ivxlcdmIVXLCDM]{1,4}[).:]$")


def sub_or_superscript(word: C) -> Column:
    return _c(word).rlike(f"[{SCRIPTS}]")


def lone_conjunct(word: C) -> Column:
    return _c(word).isin("¹", "²", "³")


def opens_like_bengali(text: C) -> Column:
    return ~F.regexp_extract(_c(text), f"([{BENGALI}])", 1).isin(*"ঞংঃঁৎড়ঢ়য়")


def trim_to_bengali(text: C) -> Column:
    return F.regexp_replace(_c(text), f"^[^{BENGALI}]+|[^{BENGALI}]+$", "")


def stem_hits(text: C) -> Column:
    """How many stems, repeats counted, a text contains; stems of three characters and more."""
    return kernel.stem_hits_column(_c(text))


def _py_decompose(s: str) -> str:
    for a, b in NUKTA:
        s = s.replace(b, a)
    return s


def reads_as_bengali(text: C) -> Column:
    return stem_hits(text) >= 1


def reads_as_bengali_strict(text: C) -> Column:
    hits = stem_hits(text)
    return (hits >= 2) & (hits * 60 >= count_of(text, BENGALI))


def english_bare(word: C) -> Column:
    """A word in lower case without what isn't a letter at either end; empty unless it is ASCII."""
    word = _c(word)
    return F.when(word.rlike(r"^[\x00-\x7F]*$"), F.regexp_replace(F.lower(word), "^[^a-z]+|[^a-z]+$", "")).otherwise(F.lit(""))


def clean_bengali(word: C) -> Column:
    """A word list's entry as it is looked up, or null if it is none."""
    trimmed = canonical(F.regexp_replace(_c(word), f"^[\\uFEFF{SPACE}]+|[\\uFEFF{SPACE}]+$", ""))
    return F.when(trimmed.rlike(f"^[{BENGALI}]{{2,}}$"), trimmed)


def clean_english(word: C) -> Column:
    trimmed = F.lower(F.regexp_replace(_c(word), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(trimmed.rlike("^[a-z]{2,}$"), trimmed)


def significant_class() -> str:
    """The characters that the rules read as something else, as a regex class."""
    own = {c for a, _ in tables.rules("main") for c in a if not c.isspace()} | {"\\"}
    return "".join(f"\\u{ord(c):04X}" for c in sorted(own))


def testable(word: C) -> Column:
    return _c(word).rlike(f"[{BENGALI}]") & ~_c(word).rlike(f"[{significant_class()}]")


def is_legacy_font(name: C) -> Column:
    low = F.lower(_c(name))
    unicode_ = low.rlike("|".join(tables.words("unicode_font"))) | low.startswith("+")
    return ~unicode_ & low.rlike("|".join(tables.words("font")))


def is_exactly_legacy_font(name: C) -> Column:
    return F.lower(F.trim(_c(name))).isin(list(tables.words("font")))


def wilson(hits: C, total: C) -> tuple[Column, Column]:
    """The 95 % score interval of a proportion; (0, 0) of nothing."""
    z, n = 1.959963984540054, _c(total).cast("double")
    p = _c(hits) / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    none = _c(total) == 0
    low = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)))
    return low, F.when(none, 0.0).otherwise(F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n)))


def thousands(n: C) -> Column:
    return F.format_number(_c(n), 0)


def screen_safe(text: C) -> Column:
    """Control characters as their pictures."""
    controls = "".join(map(chr, range(32))) + "\x7f"
    return F.translate(_c(text), controls, "".join(chr(0x2400 + k) for k in range(32)) + "␡")


def split_parity(path: C) -> Column:
    """``tune`` or ``test`` by the parity of a path's FNV-1a hash: basis and prime are odd, so only the bytes' low bits count."""
    digits = F.regexp_extract_all(F.hex(F.encode(_c(path), "UTF-8")), F.lit("(..)"), 1)
    odd = F.size(F.filter(digits, lambda d: d.rlike("[13579BDF]$")))
    return F.when((odd + 1) % 2 == 0, "tune").otherwise("test")


def token_label(token: C, font: C) -> Column:
    """The label of a token for evaluation, from its text and its run's font."""
    token, font = _c(token), F.lower(_c(font))
    letter, family = token.rlike("[A-Za-z]"), F.coalesce(font, F.lit(""))
    core = F.regexp_replace(token, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    sutonny = F.contains(family, F.lit("sutonnymj")) | F.contains(family, F.lit("sutonnyemj"))
    return (
        F.when(token.rlike(f"[{BENGALI}]"), "unicode")
        .when(font.isNull() & letter, "unknown_font")
        .when(is_legacy_font(family), F.when(~sutonny, "other_legacy").when(token.rlike(f"[{BIJOY}]"), "legacy").otherwise("legacy_ascii"))
        .when(core.rlike(f"[{BIJOY}]"), "font_disputed")
        .when(letter, "english")
        .otherwise("inert")
    )


def extension(path: C) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1))


def kind_of(path: C) -> Column:
    """``office``, ``legacy`` or null, from the extension alone."""
    e = extension(path)
    return F.when(e.isin("docx", "xlsx", "pptx"), "office").when(e.isin("doc", "xls", "ppt"), "legacy")


def derived_name(path: C) -> Column:
    """Where a converted file goes: ``stem.unicode.ext``, old formats as their successors."""
    e = extension(path)
    written = F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1)
    modern = F.when(e.isin("doc", "xls", "ppt"), F.concat(e, F.lit("x"))).otherwise(written)
    return F.concat(F.regexp_replace(_c(path), r"\.[^./\\]+$", ""), F.lit(".unicode."), modern)


#: Parts with text: bodies, headers, notes and comments, strings, slides, and the models and drawings of diagrams and charts wherever they are.
_TEXT_PARTS = r"^(?:word/(?:document|comments|(?:footnotes|endnotes|header|footer).*)\.xml|xl/(?:sharedStrings|worksheets/sheet.*)\.xml|ppt/(?:slides/slide|notesSlides/notesSlide).*\.xml|.*/(?:diagrams/(?:data|drawing)|charts/chart).*\.xml)$"
#: Parts that only name fonts.
_FONT_PARTS = r"^(?:word/(?:styles|stylesWithEffects|numbering|fontTable|theme/theme1)|xl/styles|ppt/presentation|ppt/(?:slideMasters|slideLayouts|theme)/.*)\.xml$"
#: The part that lists the fonts that a presentation uses, as texts.
METADATA_PART = "docProps/app.xml"


def is_text_part(part: C) -> Column:
    return _c(part).rlike(_TEXT_PARTS)


def is_font_part(part: C) -> Column:
    return _c(part).rlike(_FONT_PARTS)


def is_metadata_font_part(part: C) -> Column:
    return _c(part) == METADATA_PART
