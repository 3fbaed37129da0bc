"""Harmonic packing of documents into training bins.

A document of ``w`` words belongs to class ``k`` if ``capacity/(k+1) < w <=
capacity/k``; a bin of class ``k`` takes exactly ``k`` documents of the class, so
no bin overflows and none has to know of any other. The last class takes all
that is at most ``capacity/classes`` long. A longer document than the capacity
is cut into pieces of ``capacity`` words and a rest.

Documents are dealt to lanes by a hash of id and length, about ``LANE_DOCS`` to a
lane, and each lane fills the bins of each class on its own: a worker needs one
lane's short rows only. The number of lanes is that of the documents divided by
``LANE_DOCS``, rounded up; a corpus of another size has other lanes, and with them
other bins. Each lane leaves at most one bin of a class unfilled. Only ids and
lengths are shuffled: rows that agree in both are counted first, with map-side
combining, and such copies are dealt to all lanes in turn, so a third of all rows
may be copies of one.

Defined results: null, empty and wordless texts are in no bin, and an empty table
has none. A null id comes first. Repeated rows are packed as often as they come,
and as no text is in the result, copies of one id and length are alike. A text
longer than a bin, however long, is cut into pieces. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words of a bin, and the highest class: 64 documents of at most 32 words.
CAPACITY = 2048
CLASSES = 64
#: Documents that a lane should have.
LANE_DOCS = 65_536

_WORD = r"[^ \t\n\x0B\f\r]+"


def word_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, lane_docs: int = LANE_DOCS) -> DataFrame:
    """Columns ``doc_id``, ``piece``, ``first_word``, ``words``, ``lane``, ``class``, ``bin``, ``slot``.

    A bin is named by lane, class and number; ``slot`` is the place in it. The
    piece is the document's ``words`` words from the ``first_word``-th on (from 0).
    """
    lanes = max(1, -(-docs.count() // lane_docs))
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_count("text").cast("bigint").alias("n")).where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("n").cast("string")))
    first_lane = F.conv(F.substring(name, 1, 15), 16, 10).cast("bigint")
    dealt = sized.select("doc_id", "n", "copies", first_lane.alias("name"), F.explode(F.expr(f"sequence(0L, least(copies, {lanes}L) - 1)")).alias("turn"))
    dealt = dealt.select("doc_id", "n", F.expr(f"(name + turn) % {lanes}L").alias("lane"), F.expr(f"(copies - turn + {lanes - 1}L) div {lanes}L").alias("copies"))
    cut = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))))
    words = F.expr(f"least({capacity}L, n - piece * {capacity}L)")
    rows = cut.select("doc_id", "n", "lane", "copies", "piece", (F.col("piece") * capacity).alias("first_word"), words.alias("words")).withColumn("class", F.expr(f"least({classes}L, {capacity} div words)"))
    order = Window.partitionBy("lane", "class").orderBy(F.col("doc_id").asc_nulls_first(), "n", "piece")
    numbered = rows.withColumn("k", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
    every = numbered.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("k", F.col("k") + F.col("copy"))
    return every.select("doc_id", "piece", "first_word", "words", "lane", "class", F.expr("k div class").alias("bin"), F.expr("k % class").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
    WITH lanes AS (SELECT greatest(1, CAST(ceil(count(*) / {LANE_DOCS}) AS BIGINT)) AS lanes FROM documents),
    sized AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents),
    dealt AS (SELECT doc_id, n, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || n), 1, 15) AS BIGINT) + row_number() OVER (PARTITION BY doc_id, n) - 1) % lanes AS lane FROM sized, lanes WHERE n > 0),
    cut AS (SELECT doc_id, n, lane, unnest(range((n + {CAPACITY - 1}) // {CAPACITY})) AS piece FROM dealt),
    pieces AS (SELECT doc_id, n, lane, piece, piece * {CAPACITY} AS first_word, least({CAPACITY}, n - piece * {CAPACITY}) AS words FROM cut),
    classed AS (SELECT *, least({CLASSES}, {CAPACITY} // words) AS class FROM pieces),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY lane, class ORDER BY doc_id NULLS FIRST, n, piece) - 1 AS k FROM classed)
    SELECT doc_id, piece, first_word, words, lane, class, k // class AS bin, k % class AS slot FROM numbered
"""
