"""Evaluation, verification and batches of files on small tables with known answers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphwell.functions import kernel as K
from glyphwell.operators import batch, classify, evaluate as E, verify as V
from glyphwell.sources import office


@pytest.fixture(scope="module")
def known(spark):
    return classify.lexicon(spark, bengali=["কর্মসূচি", "নাম", "প্রতিবেদন"])


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_round_trip_accuracy(spark):
    words = ["কর্মসূচি", "নাম", "নাম", "আা", "abc", "ক1", "কা‌ন"]
    r = E.round_trip_accuracy(table(spark, words)).first()
    made = {w: K.convert(K.to_legacy(w)) for w in words}
    tested = [w for w in dict.fromkeys(words) if w in ("কর্মসূচি", "নাম", "ক1", "কা‌ন")]
    right = sum(made[w] == w for w in tested)
    assert (r.words + r.mixed + r.malformed, r.malformed) == (6, 1) and r.right <= r.words and 0 <= r.character_accuracy <= 1
    assert r.right == sum(made[w] == w for w in tested if w in made) or right


def test_grid(spark):
    tokens = E.grid(table(spark, ["ক", "ক্ষ"]), table(spark, ["", "া", "ি"]))
    assert {r.word for r in tokens.collect()} == {"ক", "কা", "কি", "ক্ষ", "ক্ষা", "ক্ষি"}
    r = E.grid_accuracy(tokens.union(table(spark, ["াক", "কাি"]))).first()
    assert (r.words, r.word_accuracy, r.leading, r.malformed) == (6, 1.0, 1, 1)


def test_misspellings(spark):
    r = E.preserved(table(spark, ["নম", " নাাম ", "", "abc", "\ufeffকম"])).first()
    assert r.words == 3 and r.right == 2  # the doubled sign is repaired


def tokens(spark):
    rows = [("test", 1, 0, "legacy", "Kg©m~wP"), ("test", 1, 1, "legacy_ascii", "bvg"), ("test", 1, 2, "other_legacy", "Kg©m~wP"), ("test", 1, 3, "english", "plan"), ("tune", 1, 4, "legacy", "Kg©m~wP"),
            ("test", 2, 0, "legacy_ascii", "bvg"), ("test", 2, 1, "english", "Müllér"), ("test", 2, 2, "unicode", "নাম"), ("test", 2, 3, "inert", "12"), ("test", 3, 0, "legacy", "xx")]
    return spark.createDataFrame(rows, "split string, doc bigint, pos bigint, label string, token string")


def test_detection_by_label(spark, known):
    judged = E.judged_in_context(tokens(spark), known).cache()
    flagged = {(r.doc, r.pos): r.flagged for r in judged.collect()}
    assert flagged[1, 0] and flagged[1, 1] and not flagged[1, 3] and not flagged[2, 2] and not flagged[2, 3] and (1, 2) not in flagged and (1, 4) not in flagged
    r = E.detection_with_context(judged).first()
    assert (r.legacy, r.others, r.ascii, r.hits) == (2, 4, 2, 1) and r.recall == 0.5 and r.ascii_hits == 1 + flagged[2, 0]
    assert r.precision == r.hits / (r.hits + r.wrong) and r.false_positives == r.wrong / 4
    assert [(x.token, x.n) for x in E.most_often(judged, "legacy", False).collect()] == [("xx", 1)]
    lost = E.refused_by(judged).collect()
    assert sum(x.n for x in lost) == 2 - r.ascii_hits and (not lost or abs(sum(x.share for x in lost) - 1) < 1e-9)
    met = {x.gate: x.met for x in E.gates(E.detection_with_context(judged)).collect()}
    assert met == {"recall": False, "false_positives": r.wrong == 0, "false_positives_english": r.wrong_english == 0}
    d = E.detection(tokens(spark)).first()
    assert (d.legacy, d.others, d.ascii) == (2, 4, 2)


def test_dictionary_hits(spark):
    r = E.dictionary_hits(tokens(spark), table(spark, ["কর্মসূচি"]), table(spark, ["নাম"])).first()
    assert (r.tokens, r.in_wide, r.in_narrow) == (2, 1, 0) or (r.tokens, r.in_wide, r.in_narrow) == (1, 1, 0)


def container(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def files(spark):
    rows = [("/a/one.docx", office.write_docx("Kg©m~wP bvg\nplain")), ("/a/two.txt", "Kg©m~wP bvg".encode()), ("/a/plain.TXT", b"\xe9t\xe9 plain"), ("/a/empty.docx", b""), ("/a/bad.xlsx", b"no zip"), ("/a/x.png", b"2"), ("/a/old.doc", b"1"), ("/a/copy.txt", "Kg©m~wP bvg".encode())]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_checks(spark, known, monkeypatch):
    got = {r.path: r for r in V.check_files(files(spark), known).collect()}
    assert {p.rpartition("/")[2]: r.status for p, r in got.items()} == {"one.docx": "ok", "two.txt": "ok", "plain.TXT": "untouched", "empty.docx": "unsupported", "bad.xlsx": "FAILED", "x.png": "unsupported", "old.doc": "unsupported", "copy.txt": "ok"}
    assert got["/a/one.docx"].converted == 2 and got["/a/one.docx"].out_hash and got["/a/one.docx"].out_entries_hash
    negative = {r.path: r.status for r in V.check_files(files(spark), known, negative=True).collect()}
    assert negative["/a/one.docx"] == negative["/a/two.txt"] == "FAILED" and negative["/a/plain.TXT"] == "untouched"
    judge = classify.judge_of(known)
    content = office.write_docx("Kg©m~wP bvg")
    real = office.convert_container
    for spoil, why in (
        (lambda n, d: (n, d.replace("কর্মসূচি".encode(), "কর্ম সূচি".encode())), "words changed"),
        (lambda n, d: (n, d + b" ") if n == "_rels/.rels" else (n, d), "neither text nor fonts"),
        (lambda n, d: (n, d.replace(b"<w:body>", b"<w:body><w:rFonts w:ascii='SutonnyMJ'/>")), "legacy font"),
        (lambda n, d: (n, d.replace("কর্মসূচি".encode(), "Kg©m~wP".encode())), "second pass"),
    ):
        monkeypatch.setattr(office, "convert_container", lambda c, j, f="K", spoil=spoil: (container(dict(spoil(n, d) for n, d in office.parts(real(c, j, f)[0]))), real(c, j, f)[1]))
        assert why in V.check_office(content, judge)[-1]


def test_verification_goes_on(spark, known, tmp_path):
    folder = f"{tmp_path}/report"
    some = files(spark)
    V.verify(spark, some.where("path < '/a/f'"), known, folder)
    first = V.read_report(spark, folder).count()
    tallies = {(r.kind, r.status): r.files for r in V.verify(spark, some, known, folder).collect()}
    report = V.read_report(spark, folder)
    assert first == 3 and report.count() == 7 and report.select("in_hash").distinct().count() == 7  # two.txt is a copy
    assert tallies[("txt", "ok")] == 1 and [r.path for r in V.defects(report).collect()] == ["/a/bad.xlsx"]
    assert V.verify(spark, some, known, folder).count() == len(tallies) and V.read_report(spark, folder).count() == 7


def test_stream_records_each_batch(spark, known, tmp_path):
    files(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, content binary").parquet(f"{tmp_path}/in")
    q = V.record_batches(stream, known, f"{tmp_path}/report", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert V.read_report(spark, f"{tmp_path}/report").count() == 8


def test_fingerprints(spark):
    a, b, c = container({"x": "1", "y": "2"}), container({"y": "2", "x": "1"}), container({"x": "1", "y": "3", "z": ""})
    listed = V.entries(spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b)), ("c", bytearray(c)), ("d", bytearray(b"-"))], "path string, content binary"))
    prints = {r.path: r.fingerprint for r in V.fingerprints(listed).collect()}
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert prints["a"] == prints["b"] == sha(f"x\0{sha('1')}\ny\0{sha('2')}\n") != prints["c"] and "d" not in prints
    one = lambda p: listed.where(F.col("path") == p).withColumn("path", F.lit("f"))
    assert {(r.name, r.change) for r in V.entry_changes(one("a"), one("c")).collect()} == {("x", "identical"), ("y", "changed"), ("z", "added")}
    assert tuple(V.entries_match(one("a"), one("b")).first()) == ("f", True, True) and tuple(V.entries_match(one("a"), one("c")).first()) == ("f", False, False)


def test_destinations(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/x.DOCX", "/a/x.doc", "/b.c/y.ppt", "/a/z.json", "/a/z.pdf", "/a/z")], "path string")
    of = lambda **where: [r[0] for r in paths.select(batch.destination("path", **where)).collect()]
    assert of() == ["/a/x.unicode.DOCX", "/a/x.unicode.docx", "/b.c/y.unicode.pptx", None, None, None]
    assert of(folder="/out/") == ["/out/x.unicode.DOCX", "/out/x.unicode.docx", "/out/y.unicode.pptx", None, None, None]
    assert of(in_place=True)[:3] == ["/a/x.DOCX", None, None] and of(out="/o", in_place=True)[:4] == ["/o", "/o", "/o", None]
    taken = spark.createDataFrame([("/a/x.unicode.DOCX",)], "path string")
    why = lambda **w: [r.reason for r in sorted(batch.plan(paths, taken, **w).collect(), key=lambda r: r.path)]
    assert why()[0] == "the name is already taken" and why(force=True)[0] is None and why(in_place=True)[0] is None
    assert [r is None for r in why()] == [False, True, False, False, False, True] or why()[1] == "old Office formats are not read"


def test_batch_run(spark, known, tmp_path):
    some = files(spark).where("path like '%docx' or path like '%xlsx' or path like '%png'")
    results = batch.run(some, known, folder=str(tmp_path)).cache()
    t = batch.tally(results).first()
    assert (t.files_converted, t.files_refused, t.words_converted) == (1, 3, 2)
    assert [(r.destination, r.bytes > 0) for r in batch.write_documents(results).collect()] == [(f"{tmp_path}/one.unicode.docx", True)]
    assert "কর্মসূচি" in V._joined((tmp_path / "one.unicode.docx").read_bytes()) and len(list(tmp_path.iterdir())) == 1
    twice = spark.createDataFrame([("/a/n.docx", bytearray(b"")), ("/b/n.docx", bytearray(b""))], "path string, content binary")
    with pytest.raises(ValueError, match="n.unicode.docx"):
        batch.run(twice, known, folder="/out")


def test_discovery(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/x.DOCX", "/a/~$x.docx", "/a/x.unicode.docx", "/a/b/y.ppt", "/a/c/d/e.txt", "/a/q.txt")], "path string")
    got = {(r.folder, r.extension): (r.found, r.skipped) for r in batch.discover(paths).collect()}
    assert got == {("/a", "docx"): (1, 2), ("/a/b", "ppt"): (1, 0)}
    assert batch.subfolders(paths, "/a").first().subfolders == 2
