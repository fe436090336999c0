"""Spelling variants: a self-join of the vocabulary's trie with active-node sets, and the form that each word stands for.

Two words one edit apart share the first half of the shorter one or its last half, since the edit lies in the other.  The vocabulary is
therefore partitioned by such prefixes and suffixes; a group that still holds more than ``most`` words is split by halves of what its
words do not share yet, until at most two code points are left of each, so that no group is unbounded.  In each group a trie is built
over the words' open parts, and every node gets its active nodes, those within distance one, from the active nodes of its parent.
Terminal nodes active at terminal nodes, at distance one, are the pairs; each word keeps their number and its best partner only, so no
list of pairs leaves a task.  Where a pair shares both halves it counts in the prefix's group alone.

Words are counted before anything else (by partial sums in each task), so a word of very many documents is one row.  Chains of forms at
least double the count with each step, and are shortened by halves in a few joins.

Edge cases: null texts have no words; a null id is the empty string in the digest of a typing error; repeated rows count each; a word
without partners has n_near 0, no form, and itself as its root; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import ascii_lower
from .storage import materialize

RUN = "[a-zÀ-ÿ]+"
PARTIAL = "word string, n_near long, best_n long, best string"


def vocabulary(documents: DataFrame, least_length: int = 5, least_count: int = 3, typing: int | None = None) -> DataFrame:
    """``documents`` (doc_id, text): (word, n) of the words of whole texts, as a table.

    With ``typing`` a run of letters whose digest with its document's id is a multiple of that number loses one code point.
    """
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    length = F.char_length("run")
    runs = runs.filter(length >= least_length)
    word: Column = F.col("run")
    if typing:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % length).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
        word = F.when(F.col("h") % typing == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(counts.filter(F.col("n") >= least_count), "vocabulary")


def _halved(rows: DataFrame) -> DataFrame:
    """Each word once by the first half of its open part, and once by the last.

    ``rows`` are (key, least, open, seen, word, n): the open parts of a group have ``least`` code points or one more; ``seen`` holds the
    first halves that words in a group of last halves must differ in, for else they meet in the group of the first half.
    """
    half = F.floor(F.col("least") / 2).cast("int")
    last = F.col("least") - half
    size = F.char_length("open")
    head, tail = F.substring("open", F.lit(1), half), F.substring("open", size - last + 1, last)
    by_head = F.struct(F.concat_ws("|", "key", F.lit("p"), head).alias("key"), last.alias("least"), F.substring("open", half + 1, size).alias("open"), F.col("seen"))
    by_tail = F.struct(F.concat_ws("|", "key", F.lit("s"), tail).alias("key"), half.alias("least"), F.substring("open", F.lit(1), size - last).alias("open"), F.concat("seen", F.array(head)).alias("seen"))
    return rows.select(F.explode(F.array(by_head, by_tail)).alias("to"), "word", "n").select("to.*", "word", "n")


def groups_of(vocab: DataFrame, most: int) -> DataFrame:
    """Groups of 2 to ``most`` words that hold every pair one edit apart: (least, words), words being (open, seen, word, n)."""
    length = F.char_length("word")
    rows = vocab.select(F.explode(F.array(length, length - 1)).alias("least"), "word", "n")
    rows = rows.select(F.col("least").cast("string").alias("key"), "least", F.col("word").alias("open"), F.array().cast("array<string>").alias("seen"), "word", "n")
    found = None
    while True:
        rows = materialize(_halved(rows), "halves")
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "group-sizes")
        fit = (F.col("size") <= most) | (F.col("least") <= 1)
        met = rows.join(sizes, "key")
        own = met.filter(fit).groupBy("key").agg(F.first("least").alias("least"), F.collect_list(F.struct("open", "seen", "word", "n")).alias("words")).drop("key")
        found = own if found is None else found.unionByName(own)
        if sizes.filter(F.col("size") > most).isEmpty():
            return found
        rows = met.filter(~fit).drop("size")


class Trie:
    """A trie over strings: children by node and character, and which string ends at a node."""

    def __init__(self, strings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for k, s in enumerate(strings):
            node = 0
            for c in s:
                below = self.children[node]
                node = below.get(c, -1)
                if node < 0:
                    node = below[c] = len(self.children)
                    self.children.append({})
            self.ends[node] = k

    def pairs(self) -> Iterator[tuple[int, int]]:
        """All (i, j) whose strings are at distance one, each from both sides.

        A node's active nodes are (node, distance) within one edit.  The root's are itself and its children; a child's follow from its
        parent's: the same node by a deletion, a child by a match or a replacement, and a child of a match by an insertion.
        """
        children, ends = self.children, self.ends
        stack = [(0, {0: 0} | dict.fromkeys(children[0].values(), 1))]
        while stack:
            node, active = stack.pop()
            if node in ends:
                own = ends[node]
                for other, distance in active.items():
                    if distance and other in ends:
                        yield own, ends[other]
            for c, child in children[node].items():
                now: dict[int, int] = {}
                for other, distance in active.items():
                    if distance:
                        match = children[other].get(c)
                        if match is not None:
                            now.setdefault(match, 1)
                    else:
                        now.setdefault(other, 1)
                        for d, below in children[other].items():
                            if d != c:
                                now.setdefault(below, 1)
                                continue
                            now[below] = 0
                            for further in children[below].values():
                                now.setdefault(further, 1)
                stack.append((child, now))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a group its partners' number, and the one of largest count (then first by code point)."""
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for least, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            number: dict[int, int] = {}
            best: dict[int, tuple[int, str]] = {}
            opens = [w["open"] for w in words]
            for i, j in Trie(opens).pairs():
                if len(opens[i]) + len(opens[j]) > 2 * least + 1:
                    continue  # both are the longer ones, which meet in a group of their own
                if any(a == b for a, b in zip(words[i]["seen"], words[j]["seen"], strict=True)):
                    continue
                number[i] = number.get(i, 0) + 1
                rank = (-words[j]["n"], words[j]["word"])
                if i not in best or rank < best[i]:
                    best[i] = rank
            out += [(words[i]["word"], n, -best[i][0], best[i][1]) for i, n in number.items()]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def variants(vocab: DataFrame, most: int = 4096) -> DataFrame:
    """``vocab`` (word, n), each word once: n_near, form (the best partner, if at least twice as frequent), form_n and root."""
    near = groups_of(vocab, most).mapInArrow(_near, PARTIAL)
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))
    best_n = -F.col("best.less")
    found = vocab.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(best_n >= 2 * F.col("n"), F.col("best.best")).alias("form"),
        F.when(best_n >= 2 * F.col("n"), best_n).alias("form_n"),
    )
    found = materialize(found, "forms")
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a link spans
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return found.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
