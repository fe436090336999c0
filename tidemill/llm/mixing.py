"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target says how often each of its words is wanted.  The whole part of that is given to every document of the source as whole
copies; the rest, a fraction below one, is the inclusion probability of its documents in a sample whose size is fixed: the words still
missing.  Every document draws a random number from its id and text; its rank is the odds of that number divided by the odds of its
inclusion, and each source takes its documents by rank while the words fit.  What a document too long for the rest leaves open is filled
in ``FILLS`` further passes by documents that fit: those not drawn yet by rank, then those with copies left.  So a source ends within
a short document of its target.

Only sums by source and by range of ranks are grouped; a source's border is looked for among the documents of one of ``BINS`` ranges of
its ranks, so a source that holds most rows is never sorted or held in one task.  Texts are read once.

Edge cases: a null text has no words and takes none; documents without words take none; a null source is a source of its own, the last
one; null ids are drawn like others, by their text; repeated rows are rows of their own (those that tie in id and text are taken in any
order, which gives the same rows); other columns are ignored; an empty table gives no rows.  Draws depend on the id, the text and
``seed`` alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import positions, running_totals
from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of ranks among which a source's border is sought.
BINS = 4096
#: Passes that fill what the first one leaves open.
FILLS = 2


def targets_of(sizes: DataFrame, weights: tuple[int, ...], copies: int) -> DataFrame:
    """``sizes`` (source, source_size): the words each source is to give, as num and den (longs, target = num / den).

    Weights repeat over the sources by code point, null last.  A source stops at ``copies`` times its size; what it leaves is shared
    again by weight among the others, which is settled by whole numbers: all words less those of the sources that stopped, over the
    weights of the rest.  Each round sums the sources once.
    """
    placed = positions(sizes, [F.col("source").isNull(), "source"], name="place")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    placed = materialize(placed.select("source", "source_size", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * copies
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    share = (total, placed.agg(F.sum("weight")).first()[0] or 1)  # words a unit of weight, as a fraction

    def above(share: tuple[int, int]) -> Column:
        return F.col("weight") * share[0] > cap * share[1]

    while True:
        left = placed.agg(F.sum(F.when(above(share), cap)).alias("words"), F.sum(F.when(~above(share), F.col("weight"))).alias("weight")).first()
        now = (total - (left["words"] or 0), left["weight"] or 1)
        if now == share:
            break
        share = now
    full = above(share)
    return placed.select(
        "source",
        "source_size",
        F.when(full, cap).otherwise(F.col("weight") * share[0]).alias("num"),
        F.when(full, F.lit(1)).otherwise(F.lit(share[1])).cast("long").alias("den"),
    )


def _times(copies: int) -> Column:
    """How often the cuts ``made`` take a document: each takes it once more if it is short enough for what was open, has not all its
    copies, and stands before the border.  Documents taken less often stand first."""

    def once_more(times: Column, cut: Column) -> Column:
        at = F.col("bin") + times * BINS
        inside = cut["bin"].isNull() | (at < cut["bin"]) | ((at == cut["bin"]) & (F.struct("rank", "row") <= cut["last"]))
        return times + F.when((F.col("size") <= cut["open"]) & (F.col("whole") + times < copies) & inside, 1).otherwise(0)

    return F.aggregate("made", F.lit(0), once_more)


def _cut(docs: DataFrame, cuts: DataFrame, copies: int) -> DataFrame:
    """``cuts`` (key, open, made) after one more pass over the ranked ``docs``: what is still open, and the array of cuts made.

    A cut is (open, bin, last): the words open before it, the range of ranks in which they ran out (null: all fitted), and the last
    rank taken there (null: none).
    """
    left = docs.join(cuts.filter("open > 0"), F.col("source").eqNullSafe(F.col("key"))).filter(F.col("size") <= F.col("open"))
    left = left.withColumn("times", _times(copies)).filter(F.col("whole") + F.col("times") < copies).withColumn("bin", F.col("bin") + F.col("times") * BINS)
    upto = Window.partitionBy("source").orderBy("bin")
    bins = left.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("open").alias("open")).withColumn("sum", F.sum("words").over(upto))
    over = F.col("sum") > F.col("open")
    shape = bins.groupBy(F.col("source").alias("own")).agg(F.min(F.when(over, F.col("bin"))).alias("border"), F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("below"))
    at_border = left.join(shape, F.col("source").eqNullSafe(F.col("own")) & (F.col("bin") == F.col("border"))).select("source", "rank", "row", "size", "below", "open")
    summed = running_totals(at_border, "size", ["rank", "row"], ["source"]).filter(F.col("below") + F.col("total") <= F.col("open"))
    last = summed.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("rank", "row")).alias("last"), F.sum("size").alias("got"))
    met = cuts.join(shape, F.col("key").eqNullSafe(F.col("own")), "left").join(last, F.col("key").eqNullSafe(F.col("of")), "left")
    made = F.struct("open", F.col("border").alias("bin"), "last")
    return materialize(
        met.select(
            "key",
            (F.col("open") - F.coalesce("below", F.lit(0)) - F.coalesce("got", F.lit(0))).alias("open"),
            # a source of which no document was short enough has no row in `shape`
            F.when(F.col("below").isNull(), F.col("made")).otherwise(F.concat("made", F.array(made))).alias("made"),
        ),
        "cuts",
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), copies: int = 3, seed: int = 12) -> DataFrame:
    """``documents`` (doc_id, text, source): doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    text = F.col("text").cast("string")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))
    docs = documents.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # 48 bits of the digest, as a number strictly between 0 and 1
        ((F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)).alias("u"),
        F.monotonically_increasing_id().alias("row"),
    )
    docs = materialize(docs, "sizes")
    shares = targets_of(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, copies)
    shares = shares.withColumn("whole", F.expr("CASE WHEN source_size > 0 THEN num div (den * source_size) ELSE 0L END"))
    shares = materialize(shares.withColumn("open", F.expr("num div den") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "key"), "shares")
    part = F.col("open") / F.col("source_size")
    rank = F.when(F.col("open") > 0, (F.col("u") / (1 - F.col("u"))) / (part / (1 - part)))
    chosen = docs.join(shares.filter("open > 0").select("key", "open", "source_size", "whole"), F.col("source").eqNullSafe(F.col("key"))).filter("size > 0")
    ranked = chosen.select("source", "size", "row", "whole", rank.alias("rank")).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    none = F.array().cast("array<struct<open:bigint,bin:int,last:struct<rank:double,row:bigint>>>")
    cuts = shares.select("key", "open", none.alias("made"))
    for _ in range(FILLS + 1):
        cuts = _cut(ranked, cuts, copies)
    made = cuts.select(F.col("key").alias("of"), "made")
    told = docs.join(shares.join(made, F.col("key").eqNullSafe(F.col("of"))), F.col("source").eqNullSafe(F.col("key")))
    told = told.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    more = F.when(F.col("size") > 0, _times(copies)).otherwise(0)
    return told.select("doc_id", "size", "source_size", (F.col("num") / F.col("den")).alias("target"), ((F.col("whole") + more) * F.col("size")).alias("taken"))
