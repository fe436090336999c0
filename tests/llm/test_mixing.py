"""The mix against a plain loop over its contract and its draw."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from tidemill.llm.mixing import BINS, FILLS, mix

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, copies):
    """Share, stop at the cap, share again: the contract's own words, by fractions of whole numbers."""
    weight = {s: weights[n % len(weights)] for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    stopped = set()
    while True:
        num = sum(sizes.values()) - sum(copies * sizes[s] for s in stopped)
        den = sum(w for s, w in weight.items() if s not in stopped) or 1
        over = {s for s in sizes if s not in stopped and weight[s] * num > copies * sizes[s] * den}
        if not over:
            return {s: (copies * sizes[s], 1) if s in stopped else (weight[s] * num, den) for s in sizes}
        stopped |= over


def plain(docs, weights=(5, 2, 1), copies=3, seed=12):
    rows = []
    for doc, text, source in docs:
        digest = hashlib.md5((text or "").encode()).hexdigest()
        draw = hashlib.md5(f"{seed}:{'-' if doc is None else doc}:{digest}".encode()).hexdigest()
        rows.append({"doc": doc, "source": source, "size": len(WORD.findall(text or "")), "u": (int(draw[:12], 16) + 0.5) / 2**48, "times": 0})
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    out = []
    for source, (num, den) in shares(sizes, weights, copies).items():
        own, size = [r for r in rows if r["source"] == source], sizes[source]
        whole = num // (den * size) if size else 0
        left = num // den - whole * size
        for r in own if left else ():
            part = left / size
            r["rank"] = (r["u"] / (1 - r["u"])) / (part / (1 - part))
            r["bin"] = math.floor(r["rank"] / (1 + r["rank"]) * BINS)
        for _ in range(FILLS + 1 if left else 0):
            able = sorted((r for r in own if 0 < r["size"] <= left and whole + r["times"] < copies), key=lambda r: (r["bin"] + r["times"] * BINS, r["rank"]))
            for r in able:
                if r["size"] > left:
                    break
                left -= r["size"]
                r["times"] += 1
        out += [(r["doc"], r["size"], size, num / den, (whole + r["times"]) * r["size"]) for r in own]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def corpus(n=400):
    texts = [" ".join(f"w{k}" for k in range(1 + (i * 37) % 90 if i % 40 else 900)) for i in range(n)]
    sources = [["a", "big", "big", "big", "é", None, "tiny"][i % 7] if i % 7 != 6 or i < 30 else "big" for i in range(n)]
    return [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]


def test_rows_equal_the_plain_loop_and_sources_meet_their_targets(spark):
    """With null and empty texts, a null id and source, repeated rows, a very long text, and other columns of the operator's own names."""
    odd = [(None, "a b c", None), (None, None, None), (803, "", "x"), (804, None, "x"), *[(805, "same words here", "x")] * 9, (806, " \t\n", "y"), (900, "long " * 300_000, "big")]
    docs = [*corpus(), *odd]
    wide = spark.createDataFrame(docs, SCHEMA).withColumn("size", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("target", F.lit(None)).withColumn("row", F.lit(1))
    found = mix(wide.repartition(5))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert rows_of(found) == plain(docs)


def test_sources_meet_their_targets_and_stop_at_three_times_their_size(spark):
    docs = [(500, "one two", "0"), *corpus()]
    got = rows_of(mix(spark.createDataFrame(docs, SCHEMA).orderBy(F.desc("doc_id")).coalesce(1)))
    assert got == plain(docs)
    by_id = {d: s for d, _, s in docs}
    for source in {s for _, _, s in docs}:
        own = [r for r in got if by_id[r[0]] == source]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= max(20, 0.01 * own[0][3])
        assert all(r[4] % r[1] == 0 and r[4] <= 3 * r[1] for r in own)
    assert next(r[3:] for r in got if r[0] == 500) == (6.0, 6)


def test_a_repeated_row_is_not_all_or_nothing(spark):
    docs = [*[(1, "a b c d", "s")] * 200, *[(2, "x y", "t")] * 300]
    got = mix(spark.createDataFrame(docs, SCHEMA)).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in got)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
