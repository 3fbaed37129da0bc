"""Office containers as tables of text runs, and back.

A container is a ZIP of XML parts. ``read_runs`` lists files with ``binaryFile``,
so listing and reading are distributed, and parses each in its task. ``convert_files``
converts a file where it is: the runs of a part are joined, its words are judged
in that context, every run gets back what stands in it, and only the bytes of text
and font names that change are replaced. Nothing is shuffled. A damaged or
oversized file gives one row with an ``error``; it never fails the job.
"""

from __future__ import annotations

import bisect
import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphwell.functions import kernel, tables, text as X
from glyphwell.functions.judge import Judge
from glyphwell.operators import classify

ENTRIES, PART_BYTES, ARCHIVE_BYTES = 4096, 256 << 20, 512 << 20
RUNS = "path string, part string, run_ix int, text string, font string, error string"
_TEXT_PART, _FONT_PART = re.compile(X._TEXT_PARTS), re.compile(X._FONT_PARTS)
_FONT_ELEMENTS = frozenset("rFonts latin rFont name ea cs sym font altName".split())
_FONT_NAMES = ("ascii", "hAnsi", "cs", "typeface", "val")
_TEXT_ELEMENTS, _LINE_ENDS = frozenset(("t", "w:t", "a:t")), frozenset(("p", "tc", "br", "si"))


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def runs_of_part(xml: bytes) -> list[tuple[str, str | None]]:
    """Text and explicit font of every run, with a line feed at the end of paragraphs, cells, breaks and items."""
    out: list[tuple[str, str | None]] = []
    font: list[str | None] = [None]
    inside: list[list[str]] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, given: dict) -> None:
        local = _local(name)
        if local == "r":
            font[0] = None
        elif local in ("rFonts", "latin", "rFont"):
            font[0] = next((v for k in _FONT_NAMES for n, v in given.items() if _local(n) == k and v), font[0])
        elif name in _TEXT_ELEMENTS:
            inside.append([])

    def end(name: str) -> None:
        local = _local(name)
        if name in _TEXT_ELEMENTS and inside:
            if value := "".join(inside.pop()):
                out.append((value, font[0]))
        elif local in _LINE_ENDS:
            out.append(("\n", None))

    def refuse(*_: object) -> None:
        raise ValueError("the part declares entities")

    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, refuse
    parser.CharacterDataHandler = lambda data: inside and inside[-1].append(data)
    parser.Parse(xml, True)
    return out


def parts(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of every entry, within the limits."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > ENTRIES:
            raise ValueError(f"more than {ENTRIES} entries")
        total = 0
        for entry in entries:
            total += entry.file_size
            if entry.file_size > PART_BYTES or total > ARCHIVE_BYTES:
                raise ValueError("too large")
            with archive.open(entry) as f:
                data = f.read(PART_BYTES + 1)
            if len(data) > PART_BYTES:
                raise ValueError("too large")
            yield entry.filename, data


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``run_ix``, ``text``, ``font``, ``error`` of the Office files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return runs(files.where(office_files("path")).select("path", "content"))


def office_files(path: X.C) -> Column:
    """Files to convert, whatever the case of their extension: no lock files, and none that a conversion made."""
    return (X.kind_of(path) == "office") & ~X._c(path).rlike(r"((^|/)~\$[^/]*|\.unicode\.[^/]+)$")


#: Rows, or bytes of documents and texts, that a step of Python gives back at once.
ROWS, BYTES = 10_000, 8 << 20


def runs(files: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "part", "run_ix", "text", "font", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, name, k, text, font, None) for name, xml in parts(content) if _TEXT_PART.match(name) for k, (text, font) in enumerate(runs_of_part(xml))]
                except Exception as e:  # a bad file is a row
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(parse, RUNS)


def texts(files: DataFrame) -> DataFrame:
    """``path``, ``text``, ``error``: the texts of all runs of a file joined, which no other task is needed for; null for a file without a run."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "text", "error"]
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = [text for name, xml in parts(content) if _TEXT_PART.match(name) for text, _ in runs_of_part(xml)]
                    rows.append((path, "".join(found) if found else None, None))
                except Exception as e:  # a bad file is a row
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
                size += len(rows[-1][1] or "")
                if size >= BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(parse, "path string, text string, error string")


def first_run(document: X.C) -> Column:
    """The text of the first run of a container; null if it is none."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def of(content: bytes | None) -> str | None:
            try:
                return next(text for name, xml in parts(content) if _TEXT_PART.match(name) for text, _ in runs_of_part(xml)) if content is not None else None
            except Exception:  # a bad file has none
                return None

        return values.map(of)

    return run(X._c(document))


_TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTRIBUTE = re.compile(rb"""([\w:.-]+\s*=\s*)("[^"]*"|'[^']*')""")


@dataclass
class Summary:
    """What a conversion did: words converted, words left, font names changed, words whose two-part vowels were composed."""

    converted: int = 0
    untouched: int = 0
    fonts: int = 0
    normalised: int = 0

    def __iadd__(self, other: Summary) -> Summary:
        for f in fields(self):
            setattr(self, f.name, getattr(self, f.name) + getattr(other, f.name))
        return self

    @property
    def changed(self) -> bool:
        return bool(self.converted or self.fonts or self.normalised)


class _Edits:
    """Replacements of bytes of a part; all other bytes stay as they are."""

    def __init__(self, xml: bytes, font: str) -> None:
        self.xml, self.font, self.out, self.fonts = xml, escape(font, {'"': "&quot;", "'": "&apos;"}).encode(), [], 0

    def tag(self, at: int) -> re.Match:
        return _TAG.match(self.xml, at)

    def replace(self, first: int, last: int, data: bytes) -> None:
        self.out.append((first, last, data))

    def rename(self, at: int, given: dict) -> None:
        """Replace the legacy fonts among the attributes of the element at ``at``."""
        if not any(kernel.legacy_font(v) for v in given.values()):
            return
        tag = self.tag(at)
        self.fonts += 1
        values = iter(given.values())  # as written, and in that order
        for m in _ATTRIBUTE.finditer(self.xml, at, tag.end()):
            if kernel.legacy_font(next(values)):
                self.replace(m.start(2) + 1, m.end(2) - 1, self.font)

    def done(self) -> bytes:
        parts, at = [], 0
        for first, last, data in sorted(self.out):
            parts += [self.xml[at:first], data]
            at = last
        return b"".join([*parts, self.xml[at:]])


def _parser() -> expat.XMLParserType:
    parser = expat.ParserCreate(encoding="utf-8")
    parser.buffer_text, parser.ordered_attributes = True, False

    def refuse(*_: object) -> None:
        raise ValueError("the part declares entities")

    parser.EntityDeclHandler = refuse
    return parser


def text_of_run(parts: list[str], starts: list[int], changed: dict[int, str], composed: dict[int, str], low: int, high: int) -> str:
    """What stands in characters [low, high) after conversion: an unchanged piece in its part, a changed one whole where it begins."""
    out, k = [], bisect.bisect_right(starts, low) - 1
    while k < len(parts) and starts[k] < high:
        segment = parts[k]
        stop = starts[k] + len(segment)
        if k in changed:
            out.append(changed[k] if starts[k] >= low else "")
        elif k in composed and low <= starts[k] and stop <= high:
            out.append(composed[k])  # composed: as long as it comes out
        elif stop > low:
            out.append(segment[max(low - starts[k], 0) : high - starts[k]])
        k += 1
    return "".join(out)


def convert_part(xml: bytes, judge: Judge, font: str, only_read: bool = False) -> tuple[bytes, Summary]:
    """A text part with its legacy words in Unicode and its legacy fonts renamed.

    With ``only_read`` a run that keeps a word which its legacy font draws as
    Bengali keeps the font as well.
    """
    joined = "".join(t for t, _ in runs_of_part(xml))
    pieces, first, changed, composed = judge.judged(joined)
    starts = list(itertools.accumulate(map(len, pieces), initial=0))[:-1]
    made = Summary(len(changed), len(range(first, len(pieces), 2)) - len(changed), 0, len(composed))
    touched = [(starts[k], starts[k] + len(pieces[k])) for k in sorted(changed.keys() | composed.keys())]
    ends = [stop for _, stop in touched]
    edits, parser = _Edits(xml, font), _parser()
    cursor, inside, content, run_fonts, kept = 0, False, [], [], False

    def start(name: str, given: dict) -> None:
        nonlocal inside, content, run_fonts, kept
        place = parser.CurrentByteIndex
        if name in _TEXT_ELEMENTS:
            inside, content = True, [edits.tag(place).end()]
        elif _local(name) in _FONT_ELEMENTS:
            run_fonts.append((place, given))
        elif _local(name) == "r":
            flush()
            run_fonts, kept = [], False

    def flush() -> None:
        nonlocal run_fonts
        if not (only_read and kept):
            for place, given in run_fonts:
                edits.rename(place, given)
        run_fonts = []

    def end(name: str) -> None:
        nonlocal cursor, inside, kept
        if name in _TEXT_ELEMENTS:
            if inside and (old := "".join(content[1:])):
                near = bisect.bisect_right(ends, cursor)  # the first touched piece that ends in the run or after it
                if near < len(touched) and touched[near][0] < cursor + len(old):
                    new = text_of_run(pieces, starts, changed, composed, cursor, cursor + len(old))
                    if new != old:
                        edits.replace(content[0], parser.CurrentByteIndex, escape(new).encode())
                k = bisect.bisect_right(starts, cursor) - 1
                while only_read and k < len(pieces) and starts[k] < cursor + len(old):
                    kept |= (k - first) % 2 == 0 and k not in changed and bool(re.search("[A-Za-z]", pieces[k]))
                    k += 1
                cursor += len(old)
            inside = False
        elif _local(name) in _LINE_ENDS:
            cursor += 1
        if _local(name) == "r":
            flush()
            kept = False

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: inside and content.append(data)
    parser.Parse(xml, True)
    flush()
    made.fonts = edits.fonts
    return edits.done(), made


def rename_fonts(xml: bytes, font: str) -> tuple[bytes, Summary]:
    """A part without text with its legacy fonts renamed, in the attributes of elements that name fonts."""
    edits, parser = _Edits(xml, font), _parser()
    parser.StartElementHandler = lambda name, given: edits.rename(parser.CurrentByteIndex, given) if _local(name) in _FONT_ELEMENTS else None
    parser.Parse(xml, True)
    return edits.done(), Summary(fonts=edits.fonts)


def rename_listed_fonts(xml: bytes, font: str) -> tuple[bytes, Summary]:
    """The properties part: texts that are exactly a legacy font's name are replaced."""
    edits, parser, content = _Edits(xml, font), _parser(), []
    known = set(tables.words("font"))

    def flush() -> None:
        if content and "".join(content[1:]).strip().lower() in known:
            edits.replace(content[0], parser.CurrentByteIndex, escape(font).encode())
            edits.fonts += 1
        content.clear()

    def text(data: str) -> None:
        if not content:
            content.append(parser.CurrentByteIndex)
        content.append(data)

    parser.buffer_text = False
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = lambda *_: flush(), lambda *_: flush(), text
    parser.Parse(xml, True)
    return edits.done(), Summary(fonts=edits.fonts)


def convert_container(content: bytes, judge: Judge, font: str = "Kalpurush", only_read: bool = False) -> tuple[bytes, Summary]:
    """A container with its text and font parts converted; parts in which nothing changes keep their bytes.

    A worksheet without inline strings is not parsed: its text is among the shared strings.
    """
    out, total = io.BytesIO(), Summary()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data, made in converted_parts(parts(content), judge, font, only_read):
            total += made
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue(), total


def converted_parts(entries: Iterable[tuple[str, bytes]], judge: Judge, font: str = "Kalpurush", only_read: bool = False) -> Iterator[tuple[str, bytes, Summary]]:
    """Name and bytes of every entry after conversion, and what that did."""
    for name, data in entries:
        made = Summary()
        if name.startswith("xl/worksheets/sheet") and b"inlineStr" not in data:
            new = data
        elif _TEXT_PART.match(name):
            new, made = convert_part(data, judge, font, only_read)
        elif _FONT_PART.match(name):
            new, made = rename_fonts(data, font)
        elif name == X.METADATA_PART:
            new, made = rename_listed_fonts(data, font)
        else:
            new = data
        yield name, new if made.changed else data, made


def settle(content: bytes, judge: Judge, font: str = "Kalpurush") -> tuple[bytes, Summary]:
    """A made container converted until another conversion changes nothing, with all counts; words left are those of the last."""
    total = Summary()
    for _ in range(8):
        content, made = convert_container(content, judge, font)
        total.converted, total.fonts, total.normalised, total.untouched = total.converted + made.converted, total.fonts + made.fonts, total.normalised + made.normalised, made.untouched
        if not made.changed:
            break
    return content, total


CONVERTED = "path string, document binary, converted bigint, untouched bigint, fonts_changed bigint, normalised bigint, error string"


def convert_files(files: DataFrame, known: DataFrame, font: str = "Kalpurush", only_read: bool = False) -> DataFrame:
    """``path``, ``document``, the counts of ``Summary`` and ``error`` of each file of ``files`` (``path``, ``content``).

    ``known`` is a lexicon of ``operators.classify``.
    """
    judge = classify.judge_of(known)
    if judge is None:
        raise ValueError(f"files are converted with word lists of at most {classify.BROADCAST_WORDS} entries")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "document", "converted", "untouched", "fonts_changed", "normalised", "error"]
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    document, made = convert_container(content, judge, font, only_read)
                    rows.append((path, document, made.converted, made.untouched, made.fonts, made.normalised, None))
                except Exception as e:  # a bad file is a row
                    rows.append((path, None, 0, 0, 0, 0, f"{type(e).__name__}: {e}"))
                size += len(rows[-1][1] or b"")
                if size >= BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(rewrite, CONVERTED)


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{part}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{part}"/></Relationships>'


def xml_escape(text: str) -> str:
    return escape(_CONTROL.sub("", text), {'"': "&quot;", "'": "&apos;"})


def column_name(n: int) -> str:
    """A sheet's column: 0 is A, 26 is AA."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _zip(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in entries.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), xml.encode("utf-8"), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_docx(text: str) -> bytes:
    """A minimal document: a paragraph for each line, tabs as tab elements."""
    tab = "</w:t><w:tab/><w:t xml:space=\"preserve\">"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{tab.join(xml_escape(c) for c in line.split(chr(9)))}</w:t></w:r></w:p>' for line in text.split("\n"))
    part = "word/document.xml"
    return _zip({"[Content_Types].xml": _TYPES.format(part=part, kind="wordprocessingml.document"), "_rels/.rels": _RELS.format(part=part), part: f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def write_xlsx(text: str) -> bytes:
    """A minimal workbook of one sheet: a row for each line, a cell for each tab-separated field."""
    rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{xml_escape(v)}</t></is></c>' for c, v in enumerate(line.split("\t"))) + "</row>" for r, line in enumerate(text.split("\n"), 1))
    main, sheet = "xl/workbook.xml", "xl/worksheets/sheet1.xml"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    types = _TYPES.format(part=main, kind="spreadsheetml.sheet").replace("</Types>", f'<Override PartName="/{sheet}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
    rels = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    book = f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    return _zip({"[Content_Types].xml": types, "_rels/.rels": _RELS.format(part=main), main: book, "xl/_rels/workbook.xml.rels": rels, sheet: f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns}><sheetData>{rows}</sheetData></worksheet>'})


def slides_of(lines: list[str]) -> tuple[str, list[str]]:
    """Title and body of a slide: the first line that isn't blank, and what follows it."""
    at = next((k for k, line in enumerate(lines) if line.strip()), len(lines))
    return (lines[at].strip(), lines[at + 1 :]) if at < len(lines) else ("", [])


_OPEN = "http://schemas.openxmlformats.org"
_DRAWING, _LINKS, _SLIDES = f"{_OPEN}/drawingml/2006/main", f"{_OPEN}/officeDocument/2006/relationships", f"{_OPEN}/presentationml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def _links(*targets: tuple[str, str]) -> str:
    every = "".join(f'<Relationship Id="rId{k}" Type="{_LINKS}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1))
    return f'{_HEAD}<Relationships xmlns="{_OPEN}/package/2006/relationships">{every}</Relationships>'


def _slide_part(element: str, shapes: str, rest: str, more: str = "") -> str:
    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    return f'{_HEAD}<p:{element} xmlns:p="{_SLIDES}" xmlns:a="{_DRAWING}" xmlns:r="{_LINKS}"{more}><p:cSld><p:spTree>{group}{shapes}</p:spTree></p:cSld>{rest}</p:{element}>'


def _box(number: int, top: int, height: int, size: int, lines: list[str]) -> str:
    paragraphs = "".join(f'<a:p><a:r><a:rPr lang="bn-BD" sz="{size}"/><a:t>{xml_escape(line)}</a:t></a:r></a:p>' if line else "<a:p/>" for line in lines)
    frame = f'<a:xfrm><a:off x="800000" y="{top}"/><a:ext cx="10500000" cy="{height}"/></a:xfrm><a:prstGeom prst="rect"/>'
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="Text {number}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{frame}</p:spPr><p:txBody><a:bodyPr/>{paragraphs}</p:txBody></p:sp>'


def _theme() -> str:
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), "000000 FFFFFF 222222 EEEEEE 336699 993333 669933 CC9933 663399 339999 0000EE 551A8B".split()))
    face = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface="Kalpurush"/>'
    paint = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    styles = f"<a:fillStyleLst>{paint * 3}</a:fillStyleLst><a:lnStyleLst>{f'<a:ln>{paint}</a:ln>' * 3}</a:lnStyleLst><a:effectStyleLst>{'<a:effectStyle><a:effectLst/></a:effectStyle>' * 3}</a:effectStyleLst><a:bgFillStyleLst>{paint * 3}</a:bgFillStyleLst>"
    return f'{_HEAD}<a:theme xmlns:a="{_DRAWING}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{face}</a:majorFont><a:minorFont>{face}</a:minorFont></a:fontScheme><a:fmtScheme name="plain">{styles}</a:fmtScheme></a:themeElements></a:theme>'


def write_pptx(slides: list[list[str]]) -> bytes:
    """A minimal presentation: for each slide its lines, of which the first that isn't blank is the title."""
    slides = slides or [[]]
    kinds = {"ppt/presentation.xml": "presentation.main", "ppt/slideMasters/slideMaster1.xml": "slideMaster", "ppt/slideLayouts/slideLayout1.xml": "slideLayout"} | {f"ppt/slides/slide{n}.xml": "slide" for n in range(1, len(slides) + 1)}
    declared = "".join(f'<Override PartName="/{part}" ContentType="application/vnd.openxmlformats-officedocument.presentationml.{kind}+xml"/>' for part, kind in kinds.items())
    types = f'{_HEAD}<Types xmlns="{_OPEN}/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/ppt/theme/theme1.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>{declared}</Types>'
    numbers = "".join(f'<p:sldId id="{256 + n}" r:id="rId{3 + n}"/>' for n in range(len(slides)))
    colours = " ".join(f'{a}="{b}"' for a, b in {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2", "hlink": "hlink", "folHlink": "folHlink"}.items()) + "".join(f' accent{n}="accent{n}"' for n in range(1, 7))
    entries = {
        "[Content_Types].xml": types,
        "_rels/.rels": _links(("officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'{_HEAD}<p:presentation xmlns:p="{_SLIDES}" xmlns:r="{_LINKS}"><p:sldMasterIdLst><p:sldMasterId id="2147483700" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{numbers}</p:sldIdLst><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _links(("slideMaster", "slideMasters/slideMaster1.xml"), ("theme", "theme/theme1.xml"), *(("slide", f"slides/slide{n}.xml") for n in range(1, len(slides) + 1))),
        "ppt/slideMasters/slideMaster1.xml": _slide_part("sldMaster", "", f'<p:clrMap {colours}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483701" r:id="rId1"/></p:sldLayoutIdLst>'),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _links(("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": _slide_part("sldLayout", "", "", ' type="blank"'),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _links(("slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/theme/theme1.xml": _theme(),
    }
    for n, lines in enumerate(slides, 1):
        title, body = slides_of(lines)
        shapes = (_box(2, 400000, 1300000, 3200, [title]) if title else "") + (_box(3, 1900000, 4300000, 1800, body) if body else "")
        entries[f"ppt/slides/slide{n}.xml"] = _slide_part("sld", shapes, "")
        entries[f"ppt/slides/_rels/slide{n}.xml.rels"] = _links(("slideLayout", "../slideLayouts/slideLayout1.xml"))
    return _zip(entries)
