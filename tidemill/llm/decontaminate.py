"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` consecutive words; an item of fewer words is one
window.  A document word inside any occurrence of a window is hit.  Containment of a whole window means
that every one of its shingles must occur, so one shingle suffices as the necessary prefix: the rarest
by its count in the corpus.  The join runs on that shingle alone.  Its place in the window fixes where the
occurrence would start (positional bound) and end (length bound: inside the document), and the span of the
document's words is then compared word by word, so hash collisions cannot make a hit.

Edge cases: null or wordless texts have no words and no hits; wordless items have no windows; rows with one id and
one text are one document (a null id is one too), which ``each_row`` reports once for each row; items with equal windows
are all counted; null item ids are reported as an empty string in the digest; other columns are ignored.

Scale: the corpus is read twice, whatever the items' lengths (shingle counts, then hits), and no text is shuffled where the
benchmark is broadcast: only while its measured size stays under ``broadcast_bytes``; above, shingles and anchors are
joined by shuffles that carry hashes and ids, salted so that a passage of very many documents is met in several tasks,
and the words of documents with anchors are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: everything of ASCII but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
#: Parts into which the places of a shingle are dealt where they are shuffled.
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() does just that on texts that are all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from the 0-based place ``at``; the place must leave room."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """One row for each distinct window: its words, the items that hold it, and its shingle width."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    words = words.filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = words.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda s: F.slice(F.col("words"), s + 1, window))).alias("at", "window_words"))
    return (
        cut.groupBy("window_words")
        .agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("items"))
        .select("window_words", "items", F.size("window_words").alias("n"), F.least(F.size("window_words"), F.lit(SHINGLE)).alias("width"))
    )


def _positions(docs: DataFrame, widths: list[int], marked: bool = False) -> DataFrame:
    """One row for each place and width where a document's shingle begins (and one at place -1, if marked)."""
    words = F.concat(F.array(F.lit("")), "words") if marked else F.col("words")
    at = docs.select("*", F.posexplode(words).alias("at", "_word")).drop("_word")
    if marked:
        at = at.withColumn("at", F.col("at") - 1)

    def room(width: int) -> Column:
        return (F.col("at") >= 0) & (F.col("at") + width <= F.size("words"))

    if len(widths) == 1:
        at = at.withColumn("shingle", F.when(room(widths[0]), _shingle(F.col("words"), F.col("at"), widths[0])))
    else:
        shingles = F.array(*[F.when(room(w), _shingle(F.col("words"), F.col("at"), w)) for w in widths])
        # a marked place has no shingle, and is one row
        at = at.withColumn("shingle", F.explode(F.when(F.col("at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array_compact(shingles))))
    return at if marked else at.filter(F.col("shingle").isNotNull())


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 64 << 20, each_row: bool = False) -> DataFrame:
    """``documents`` (doc_id, text) against ``benchmark`` (item_id, text).

    Returns, for each document (with ``each_row`` for each of its rows): doc_id, n_words, n_hit, n_items, items_sha256 (SHA-256 of the sorted item
    ids, comma-joined), contaminated, and items (those ids).
    """
    text = F.col("text")
    docs = documents.select("doc_id", F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    wins = windows_of(benchmark, window)
    shape = wins.agg(F.collect_set("width").alias("widths"), F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window_words", " "))).alias("bytes")).first()
    widths = sorted(shape["widths"] or [])

    def finish(rows: DataFrame) -> DataFrame:
        rows = rows if each_row else rows.dropDuplicates(["doc_id", "text_key"])
        return rows.select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "items",
        )

    n_words = F.size("words").cast("long").alias("n_words")
    if not widths:
        return finish(docs.select("doc_id", "text_key", n_words, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")))
    # Each window's bytes count for its words, its shingle table and Spark's overhead a row.
    small = (shape["bytes"] + 400 * shape["n"]) * 2 <= broadcast_bytes
    held = F.broadcast if small else (lambda d: d)

    # shingles of one, two and three words are hashes of as many values, so one table serves all widths
    steps = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width")))
    shingle = F.coalesce(*[F.when(F.col("width") == w, _shingle(F.col("window_words"), F.col("offset"), w)) for w in widths])
    shingles = wins.select("window_words", "items", "n", "width", steps.alias("offset")).withColumn("shingle", shingle)
    vocabulary = shingles.select("shingle").distinct()
    counts = _positions(docs.select("words"), widths).select("shingle").join(held(vocabulary), "shingle").groupBy("shingle").count()
    rarest = (
        shingles.join(counts, "shingle", "left")
        .groupBy("window_words")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("rare"), F.first("items").alias("items"))
        # a shingle that occurs nowhere in the corpus rules its window out
        .filter("rare.count > 0")
        .select(F.col("rare.shingle").alias("shingle"), F.col("rare.offset").alias("offset"), "window_words", "items", F.size("window_words").alias("n"))
    )

    def span(at: Column, offset: Column, n: Column, window_words: Column) -> Column:
        """The place of a window that an anchor fixes, if it lies in the document and holds the window's words."""
        start = at - offset
        same = (start >= 0) & (start + n <= F.size("words")) & (F.slice("words", start + 1, n) == window_words)
        return F.when(offset.isNotNull() & same, F.struct(start.cast("int").alias("start"), (start + n).cast("int").alias("end")))

    if small:
        rows = docs.withColumn("row", F.monotonically_increasing_id())
        found = _positions(rows, widths, marked=True).join(F.broadcast(rarest), "shingle", "left")
        found = found.select("row", "doc_id", "text_key", n_words, "at", span(F.col("at"), F.col("offset"), F.col("n"), F.col("window_words")).alias("span"), "items")
        grouped = found.filter(F.col("span").isNotNull() | (F.col("at") < 0)).groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("text_key").alias("text_key"),
            F.max("n_words").alias("n_words"),
            F.collect_set("span").alias("spans"),
            F.flatten(F.collect_set(F.when(F.col("span").isNotNull(), F.col("items")))).alias("items"),
        )
    else:
        places = _positions(docs, widths).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "at", "shingle")
        places = places.withColumn("salt", F.pmod(F.xxhash64("_id", "_key", "at"), F.lit(SALTS)))
        salted = rarest.withColumn("salt", F.explode(F.array(*[F.lit(n).cast("long") for n in range(SALTS)])))
        # rows that repeat an id and a text have one set of anchors
        anchors = places.join(salted, ["shingle", "salt"]).groupBy("_id", "_key").agg(F.collect_set(F.struct("at", "offset", "n", "window_words", "items")).alias("anchors"))
        met = docs.join(anchors, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        hits = F.transform("anchors", lambda a: F.struct(span(a["at"], a["offset"], a["n"], a["window_words"]).alias("span"), a["items"].alias("items")))
        met = met.select("doc_id", "text_key", n_words, F.filter(F.coalesce(hits, F.array()), lambda h: h["span"].isNotNull()).alias("hits"))
        grouped = met.select("doc_id", "text_key", "n_words", F.array_distinct(F.transform("hits", lambda h: h["span"])).alias("spans"), F.flatten(F.transform("hits", lambda h: h["items"])).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    return finish(grouped.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")))
