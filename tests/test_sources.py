"""Office containers, text sources and streams."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphwell.functions import kernel, text as X
from glyphwell.operators import classify
from glyphwell.sources import office, text as sources
from glyphwell.streaming import documents as streams

DOCX = """<w:document xmlns:w="w"><w:body><w:p><w:r><w:rPr><w:rFonts w:ascii="SutonnyMJ"/></w:rPr><w:t>Kg©m~wP</w:t></w:r><w:r><w:t xml:space="preserve"> and &amp; the plan</w:t></w:r></w:p></w:body></w:document>"""


def container(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


KNOWN = ["কর্মসূচি", "নাম", "প্রতিবেদন", "আমি"]


@pytest.fixture(scope="module")
def known(spark):
    return classify.lexicon(spark, bengali=KNOWN)


@pytest.fixture(scope="module")
def judge(known):
    return classify.judge_of(known)


def test_runs_and_conversion(spark, tmp_path, known):
    (tmp_path / "A.DOCX").write_bytes(container({"word/document.xml": DOCX, "word/styles.xml": '<w:styles xmlns:w="w"><w:rFonts w:ascii="SutonnyMJ"/></w:styles>', "word/media/x.png": b"\x89"}))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "a.unicode.docx").write_bytes(b"made by us")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "entity.docx").write_bytes(container({"word/document.xml": '<!DOCTYPE d [<!ENTITY x "y">]><d><t>&x;</t></d>'}))
    got = office.read_runs(spark, str(tmp_path)).collect()
    runs = [(r.text, r.font) for r in got if r.path.endswith("/A.DOCX")]
    assert runs == [("Kg©m~wP", "SutonnyMJ"), (" and & the plan", None), ("\n", None)]
    assert sorted(r.path.rpartition("/")[2] for r in got if r.error) == ["bad.docx", "entity.docx"]
    out = {r.path.rpartition("/")[2]: r for r in office.convert_files(spark.read.format("binaryFile").load(str(tmp_path)), known).collect()}
    assert out["bad.docx"].error and out["entity.docx"].error and out["bad.docx"].document is None
    with zipfile.ZipFile(io.BytesIO(out["A.DOCX"].document)) as z:
        assert z.namelist() == ["word/document.xml", "word/styles.xml", "word/media/x.png"]
        assert z.read("word/document.xml").decode() == DOCX.replace("Kg©m~wP", "কর্মসূচি").replace("SutonnyMJ", "Kalpurush")
        assert "Kalpurush" in z.read("word/styles.xml").decode()
    row = out["A.DOCX"]
    assert (row.converted, row.untouched, row.fonts_changed, row.error) == (1, 4, 2, None)


def part(*runs):
    return ('<w:document xmlns:w="w"><w:body>' + "".join(f"<w:p>{r}</w:p>" for r in runs) + "</w:body></w:document>").encode()


def run(text, font=None):
    return f'<w:r>{f"<w:rPr><w:rFonts w:ascii={chr(34)}{font}{chr(34)}/></w:rPr>" if font else ""}<w:t>{text}</w:t></w:r>'


@pytest.mark.parametrize("text", ["café", "Müller", "“Hello”", "say &quot;hi&quot; &#8217;", "a &lt; b &amp;&#x26; c", "it&apos;s", "x²", "£40", "naïve résumé", "the “plan” – done…"])
def test_other_text_keeps_its_bytes(judge, text):
    xml = part(run(text, "Arial"), run("plain"))
    out, made = office.convert_part(xml, judge, "Kalpurush")
    assert out == xml and not made.changed
    apart = run("1 2 3 4 5 6")
    mixed, made = office.convert_part(part(run(text), apart, run("Kg©m~wP")), judge, "Kalpurush")
    assert mixed == part(run(text), apart, run("কর্মসূচি")) and made.converted == 1


def test_words_across_runs_and_paragraphs(judge):
    xml = part(run("Kg©") + run("m~wP bv") + run("g"), run("bvg") + run(" &amp; cÖwZ‡e`b "))
    out, made = office.convert_part(xml, judge, "Kalpurush")
    assert [t for t, _ in office.runs_of_part(out)] == ["কর্মসূচি", " নাম", "\n", "নাম", " & প্রতিবেদন ", "\n"]
    assert made.converted == 4
    apart, _ = office.convert_part(part(run("Kg©"), run("m~wP")), judge, "Kalpurush")
    assert len(office.runs_of_part(apart)) == 4  # two words, since a paragraph ends between them


def test_plain_letters_in_a_legacy_font(judge):
    """Without a neighbour that is legacy they stay; their font is renamed as every legacy font is, unless told otherwise."""
    alone = part(run("Avwg", "SutonnyMJ"))
    out, made = office.convert_part(alone, judge, "Kalpurush")
    assert out == alone.replace(b"SutonnyMJ", b"Kalpurush") and made.converted == 0 and made.fonts == 1
    out, made = office.convert_part(alone, judge, "Kalpurush", only_read=True)
    assert out == alone and made.fonts == 0
    near = part(run("Avwg", "SutonnyMJ"), run("Kg©m~wP", "SutonnyMJ"))
    for only_read in (False, True):
        out, made = office.convert_part(near, judge, "Kalpurush", only_read)
        assert out.decode().count("Kalpurush") == 2 and "আমি" in out.decode() and made.converted == 2


def test_fonts_by_every_name_and_nowhere_else(judge):
    xml = "<a xmlns:w='w'><w:rFonts w:cs = 'Bijoy &amp; Co' w:ascii=\"Arial\" w:hint='x>y'/><latin typeface='SutonnyMJ'></latin><ea typeface='SutonnyOMJ'/><name val='SutonnyEMJ'/><w:altName w:val='AjantaMJ'/><t font='SutonnyMJ'>SutonnyMJ</t><sym font='+mj-lt'/></a>".encode()
    out, made = office.rename_fonts(xml, "A&B")
    want = xml.decode().replace("Bijoy &amp; Co", "A&amp;B").replace("typeface='SutonnyMJ'", "typeface='A&amp;B'").replace("'SutonnyEMJ'", "'A&amp;B'").replace("'AjantaMJ'", "'A&amp;B'")
    assert out.decode() == want and made.fonts == 4


def test_fonts_listed_in_properties(judge):
    xml = b"<Properties><vt:lpstr xmlns:vt='v'>SutonnyMJ</vt:lpstr><x>Bijoy</x><y> ajanta </y><z>Bijoy Bayanno</z><w>MJ &amp; SUTONNY</w></Properties>"
    out, made = office.rename_listed_fonts(xml, "Kalpurush")
    assert made.fonts == 2 and out == xml.replace(b">Bijoy<", b">Kalpurush<").replace(b"> ajanta <", b">Kalpurush<")


def test_worksheets_and_properties_of_a_container(judge):
    inline = '<worksheet><sheetData><row r="1"><c t="inlineStr"><is><t>Kg©m~wP</t></is></c><c><f>A1&amp;"Kg©m~wP"</f><v>Kg©m~wP</v></c></row></sheetData></worksheet>'
    without = "<worksheet><row><c t='s'><v>0</v><t>Kg©m~wP</t></c></row></worksheet>"
    made = container({"xl/worksheets/sheet1.xml": inline, "xl/worksheets/sheet2.xml": without, "docProps/app.xml": "<P><l>ajanta</l></P>", "xl/comments1.xml": "<c><t>Kg©m~wP</t></c>", "xl/sharedStrings.xml": "<sst><si><t>bvg</t></si><si><r><t>Kg©m~wP</t></r></si></sst>"})
    out, summary = office.convert_container(made, judge)
    parts = {n: d.decode() for n, d in office.parts(out)}
    assert parts["xl/worksheets/sheet1.xml"] == inline.replace("<t>Kg©m~wP</t>", "<t>কর্মসূচি</t>") and parts["xl/worksheets/sheet2.xml"] == without
    assert parts["docProps/app.xml"] == "<P><l>Kalpurush</l></P>" and "Kg©" in parts["xl/comments1.xml"] and parts["xl/sharedStrings.xml"] == "<sst><si><t>নাম</t></si><si><r><t>কর্মসূচি</t></r></si></sst>"
    assert (summary.converted, summary.fonts) == (3, 1)
    again, second = office.settle(out, judge)
    assert not second.converted and list(office.parts(again)) == list(office.parts(out))


def test_composed_vowels_are_kept_whole(judge):
    two_part, one = "ক\u09c7\u09be ম\u09c7\u09d7 ", "ক\u09cb ম\u09cc "
    out, made = office.convert_part(part(run(two_part + "ke") + run("ep")), judge, "K")
    assert out == part(run(one + "ke") + run("ep")) and made.normalised == 2 and made.converted == 0


def test_many_strings_cost_in_proportion(judge):
    def seconds(n):
        xml = ("<sst>" + "<si><t>bvg Kg©m~wP</t></si>" * n + "</sst>").encode()
        began = time.process_time()
        assert office.convert_part(xml, judge, "K")[1].converted == 2 * n
        return time.process_time() - began

    seconds(200)
    assert seconds(16_000) < 8 * seconds(4_000) + 0.2


@pytest.mark.parametrize("write", [office.write_docx, office.write_xlsx])
def test_writers_round_trip(write):
    text = "one\ttwo & <three>\nকর্মসূচি \x01'q'"
    parts = dict(office.parts(write(text)))
    (name,) = [n for n in parts if office._TEXT_PART.match(n)]
    got = "".join(t for t, _ in office.runs_of_part(parts[name]) if t != "\n")
    assert got == "onetwo & <three>কর্মসূচি 'q'"


def test_slides():
    assert office.slides_of(["", " Title ", "a", "", "b"]) == ("Title", ["a", "", "b"]) and office.slides_of(["", " "]) == ("", [])
    parts = dict(office.parts(office.write_pptx([["", "One & <two>", "a", "", "b"], [], ["কর্মসূচি"]])))
    texts = [[t for t, _ in office.runs_of_part(parts[f"ppt/slides/slide{n}.xml"]) if t != "\n"] for n in (1, 2, 3)]
    assert texts == [["One & <two>", "a", "b"], [], ["কর্মসূচি"]]
    linked = parts["ppt/_rels/presentation.xml.rels"].decode()
    for n in (1, 2, 3):
        assert f'Id="rId{n + 2}"' in linked and f"slides/slide{n}.xml" in linked and f'r:id="rId{n + 2}"' in parts["ppt/presentation.xml"].decode()
    for xml in parts.values():
        office._parser().Parse(xml, True)


def test_column_names():
    assert [office.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_archive_limit(monkeypatch):
    monkeypatch.setattr(office, "ENTRIES", 1)
    with pytest.raises(ValueError):
        list(office.parts(container({"a": "", "b": ""})))


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa"),), (bytearray(b"\xe9\x81"),), (None,)], "content binary")
    assert [(r.text, r.encoding) for r in sources.decode(df).collect()] == [("a", "utf-8"), ("é�", "windows-1252"), (None, None)]


def test_labelled_and_word_lists(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("split\tdoc\tlabel\tfont\ttoken\ntune\t1\tlegacy\tSutonnyMJ\ta\tb\ntest\t2\tinert\t\t7\n")
    assert [tuple(r) for r in sources.read_labelled(spark, f"{tmp_path}/l.tsv").collect()] == [("tune", 1, "legacy", "SutonnyMJ", "a\tb"), ("test", 2, "inert", None, "7")]
    (tmp_path / "w.txt").write_text("The\nthe\nit's\na\n")
    assert [r.word for r in sources.word_list(spark, f"{tmp_path}/w.txt", "en").collect()] == ["the"]
    with pytest.raises(ValueError):
        sources.read_labelled(spark, f"{tmp_path}/w.txt")


def test_labelled_tokens_and_dictionaries_are_written(spark, tmp_path):
    rows = [("tune", 1, "legacy", "SutonnyMJ", "a\tb"), ("test", 2, "inert", None, '7"')]
    tokens = spark.createDataFrame(rows, "split string, doc bigint, label string, font string, token string").repartition(2)
    sources.write_labelled(tokens, f"{tmp_path}/labelled")
    assert sorted(tuple(r) for r in sources.read_labelled(spark, f"{tmp_path}/labelled").collect()) == sorted(rows)
    (tmp_path / "w.txt").write_text("b\nno\nno\nan\nখগ\nকখ\n")
    sources.write_dictionary(sources.word_list(spark, f"{tmp_path}/w.txt", "en").union(sources.word_list(spark, f"{tmp_path}/w.txt", "bn")), f"{tmp_path}/words")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/words").orderBy("lang", "word").collect()] == [("কখ", "bn"), ("খগ", "bn"), ("an", "en"), ("no", "en")]


def test_stream_keeps_each_hash_once(spark, tmp_path):
    rows = [("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:01:00"), ("a", "2026-01-01 00:02:00")]
    spark.createDataFrame(rows, "in_hash string, ts string").selectExpr("in_hash", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("in_hash string, ts timestamp").parquet(f"{tmp_path}/in")
    q = streams.once_by_hash(stream, "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        assert sorted(r.in_hash for r in spark.table("once").collect()) == ["a", "b"]
    finally:
        q.stop()


def test_words_in_context_are_converted(spark):
    known = classify.lexicon(spark, bengali=["কর্মসূচি", "নাম", "প্রতিবেদন"])
    rows = [(1, "Kg©m~wP bvg cÖwZ†e`b"), (2, "bvg bvg bvg bvg bvg"), (3, "the plan, \t of  Kg©m~wP\nand (vi) x² done"), (4, ""), (5, None), (6, "কর্মসূচি stays")]
    out = {r.doc_id: r for r in classify.convert_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()}
    assert out[1].text == "কর্মসূচি নাম প্রতিবেদন" and out[1].converted == 3
    assert out[2].text == rows[1][1] and out[2].converted == 0
    assert out[3].text == "the plan, \t of  কর্মসূচি\nand (vi) x² done" and out[6].text == rows[5][1]


def test_detect_lines(spark):
    rows = [("Awd†mi bvgt Kg©m~wP",), ("কর্মসূচি",), ("The plan of the office is “done”",), ("123",), ("",)]
    got = [r.encoding for r in classify.detect_lines(spark.createDataFrame(rows, "text string")).collect()]
    assert got == ["legacy", "unicode", "not_bangla", "not_bangla", "not_bangla"]


def test_streams_agree_with_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet("/root/testdata/sf0.001/documents.parquet*")
    q = streams.legacy_words(stream).select("doc_id", "words", "dense_words").writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        got = {r.doc_id: (r.words, r.dense_words) for r in spark.table("judged").collect()}
    finally:
        q.stop()
    from glyphwell.plans import catalog

    want = {r.doc_id: (r.words, r.legacy) for r in catalog.QUERIES["context_window_6"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and kernel.convert("") == ""


def test_verify_stream_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = streams.event_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tallies").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert spark.table("tallies").agg(F.sum("n")).first()[0] == events.count()
    finally:
        q.stop()


def test_expressions(spark):
    df = spark.createDataFrame([("Kg©m~wP", "SutonnyMJ"), ("bvg", "SutonnyMJ"), ("bvg", None), ("2026", None), ("“quoted”", "Arial"), ("a©b", "Arial"), ("ক", "Arial"), ("x", "Bijoy"), ("y", "SutonnyOMJ")], "token string, font string")
    assert [r[0] for r in df.select(X.token_label("token", "font")).collect()] == ["legacy", "legacy_ascii", "unknown_font", "inert", "english", "font_disputed", "unicode", "other_legacy", "english"]
