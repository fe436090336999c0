import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.config import Resolution
from tidemill.errors import ValidationError
from tidemill.functions.similarity import score_pair
from tidemill.operators.components import components
from tidemill.operators.knn import _blocks, _listed, centroids, nearest
from tidemill.operators.resolution import candidate_pairs, choose_names, groups_of, resolve, surface_map
from tidemill.plans.models import hash_embedder
from tidemill.schemas import ENTITIES


def run(spark, mentions, persisted=None, rules=None):
    known = persisted if persisted is not None else spark.createDataFrame([], ENTITIES)
    return resolve(spark.createDataFrame(mentions, "surface string, type string"), known, hash_embedder(), rules or Resolution())


def test_names(spark):
    rows = [(1, "Acme"), (1, "Acme"), (1, "ACME Corporation"), (2, "Acme"), (2, "ACME"), (3, "Acme Corp."), (3, "ACME Corporation"), (3, "Acme")]
    got = {r.g: r.name for r in choose_names(spark.createDataFrame(rows, "g int, surface string"), ["g"]).collect()}
    assert got == {1: "Acme", 2: "ACME", 3: "ACME Corporation"}


def test_components(spark):
    link = lambda *p: spark.createDataFrame(p, "a string, b string")
    classes = lambda df: {r.id: r.component for r in df.collect()}
    assert classes(components(link(("a", "b"), ("b", "c")))) == {"a": "a", "b": "a", "c": "a"}
    assert classes(components(link(("a", "b"), ("c", "d")))) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(ValidationError):
        components(chain, max_size=5)


def test_variants_become_one_entity(spark):
    got = run(spark, [("Acme Corp.", "ORG"), ("ACME Corporation", "ORG"), ("Acme", "ORG"), ("Acme", "ORG"), ("Acme", "PERSON")])
    rows = {r.type: r for r in got.entities.collect()}
    assert len(rows) == 2 and rows["ORG"].name == "Acme" and rows["ORG"].aliases == ["ACME Corporation", "Acme Corp."] and rows["ORG"].mention_count == 4
    assert got.aliases.count() == 2 and got.flagged.count() == 0


def test_gray_pairs_are_flagged_not_merged(spark):
    got = run(spark, [("Widget Systems", "ORG"), ("Widget Solutions", "ORG")])
    assert got.entities.count() == 2 and got.flagged.count() == 1
    assert 0.65 < got.flagged.collect()[0].score < 0.90
    assert run(spark, [("Widget Systems", "ORG"), ("Widget Solutions", "ORG")], rules=Resolution(gray_action="ignore")).flagged.count() == 0


def test_a_second_run_keeps_ids(spark):
    first = run(spark, [("Acme Corp.", "ORG"), ("Acme", "ORG"), ("Beta", "ORG")])
    known = spark.createDataFrame(first.entities.collect(), first.entities.schema)
    again = run(spark, [("Acme", "ORG"), ("Beta GmbH", "ORG")], known)
    assert {r.canonical_id for r in again.entities.collect()} == {r.canonical_id for r in known.collect()}
    assert {r.name_normalized: r.mention_count for r in again.entities.collect()} == {"acme": 3, "beta": 2}
    maps = {r.surface: r.canonical_id for r in surface_map(again).collect()}
    assert set(maps) == {"Acme", "Beta GmbH"}


def test_near_names_merge_across_groups(spark):
    got = run(spark, [("Widget Systems Group", "ORG"), ("Widget Systems Groups", "ORG")], rules=Resolution(merge_at=0.8, reject_at=0.5))
    assert [r.mention_count for r in got.entities.collect()] == [2]
    none = resolve(spark.createDataFrame([], "surface string, type string"), spark.createDataFrame([], ENTITIES), hash_embedder())
    assert none.entities.count() == 0 and none.surfaces.select(F.count("*")).first()[0] == 0


def typo(rng, name):
    at = rng.randrange(len(name))
    kind = rng.random()
    if kind < 0.3:
        return name[:at] + name[at + 1 :]
    if kind < 0.6:
        return name[:at] + rng.choice("aeiourst") + name[at:]
    if kind < 0.8 and at + 1 < len(name):
        return name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    words = name.split()
    rng.shuffle(words)
    return " ".join(words)


def test_blocks_keep_what_all_pairs_find(spark):
    """Recall of merges and gray pairs at least 0.95 against the comparison of all names, from at most 25 pairs a name."""
    rng = random.Random(3)
    syllables = "ba ke mo ri ta lu ven dor nis gal pe ros".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    names = [" ".join([word() for _ in range(rng.randint(1, 3))] + rng.choice([[], ["group"], ["systems"]])) for _ in range(150)]
    mentions = [(n, "ORG") for n in names] + [(typo(rng, n), "ORG") for n in names for _ in range(2)]
    groups = groups_of(spark.createDataFrame(mentions, "surface string, type string"), Resolution()).withColumn("vector", hash_embedder()(F.col("name_normalized"))).cache()
    none = spark.createDataFrame([], "canonical_id string, name string, name_normalized string, type string, mention_count long, vector array<float>")

    def useful(rules, **more):
        pairs = candidate_pairs(groups, none, rules, **more)
        score = score_pair(F.col("name_normalized"), F.col("c_name_normalized"), F.col("type"), F.col("c_type"), F.col("cosine"), Resolution())
        rows = pairs.select("name_normalized", "c_name_normalized", score.alias("score")).collect()
        return {(r[0], r[1]) for r in rows if r.score > 0.65}, len(rows)

    true, all_rows = useful(Resolution(), exact=True)
    n = groups.count()
    assert n > 400 and all_rows <= n * 25 and len(true) > 100
    # lists of about 32 names, of which each name meets a third
    got, rows = useful(Resolution(), list_rows=32, probes=n // 32 // 3)
    assert len(got & true) >= 0.95 * len(true) and rows <= n * 25


def test_names_that_share_no_spelling_meet_by_their_vectors(spark):
    """No word, beginning or end in common: equal vectors alone make them candidates."""
    same = lambda c: F.array(*[F.lit(float(x)) for x in (1, 0, 0)])
    mentions = spark.createDataFrame([("Jon Smyth", "PERSON"), ("John Smith", "PERSON"), ("John Smith", "ORG")], "surface string, type string")
    rules = Resolution(merge_at=0.8)
    got = resolve(mentions, spark.createDataFrame([], ENTITIES), same, rules)
    exact = resolve(mentions, spark.createDataFrame([], ENTITIES), same, rules, exact=True)
    for r in (got, exact):
        assert sorted((x.type, x.mention_count) for x in r.entities.collect()) == [("ORG", 1), ("PERSON", 2)]


def numbered(spark, n, width=16, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(max(1, n // 20), width))
    rows = middle[rng.integers(0, len(middle), n)] + 0.15 * rng.normal(size=(n, width))
    rows[::97] = rows[0]  # very many equal vectors
    rows[5] = 0
    return rows, spark.createDataFrame([(f"g{i:05d}", "abc"[i % 3] if i % 50 else None, i, [float(v) for v in r]) for i, r in enumerate(rows)], "gid string, kind string, place long, vector array<double>").repartition(5)


def test_nearest_in_full_equals_brute_force(spark):
    rows, df = numbered(spark, 400)
    unit = np.divide(rows, np.linalg.norm(rows, axis=1, keepdims=True), out=np.zeros_like(rows), where=np.linalg.norm(rows, axis=1, keepdims=True) > 0)
    for before in (False, True):
        got = {}
        for r in nearest(df, df, 7, before=before, block=60).collect():
            got.setdefault(int(r.gid[1:]), []).append((int(r.c_gid[1:]), r.cosine))
        for i in range(400):
            able = [j for j in range(400) if i % 50 and j % 50 and i % 3 == j % 3 and (j < i or not before)]
            best = sorted(able, key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:7]
            assert sorted(j for j, _ in got.get(i, [])) == sorted(best)
            assert all(abs(c - unit[i] @ unit[j]) < 1e-9 for j, c in got.get(i, []))


def test_recall_and_work_of_the_inverted_file(spark):
    """Over 250 rows a kind: recall at least 0.95 of the true neighbours, from a share of all comparisons."""
    _, df = numbered(spark, 3000)
    df = df.cache()
    full = {(r.gid, r.c_gid) for r in nearest(df, df, 10, before=True).collect()}
    index = centroids(df, list_rows=50)
    assert 40 <= len(index) <= 60
    listed = nearest(df, df, 10, index, probes=24, before=True)
    found = {(r.gid, r.c_gid) for r in listed.collect()}
    assert len(found & full) >= 0.95 * len(full)
    assert len(found) <= 3000 * 10
    lists = _listed(df, index, 1).groupBy("kind", "list").count().collect()
    probed = {(r.kind, r.list): r["count"] for r in _listed(df, index, 24).groupBy("kind", "list").count().collect()}
    assert sum(r["count"] * probed.get((r.kind, r.list), 0) for r in lists) < 0.65 * 3 * 1000 * 1000


def test_one_list_that_holds_most_rows_is_cut_into_blocks(spark):
    equal = spark.range(3000).select(F.format_string("g%05d", "id").alias("gid"), F.lit("a").alias("kind"), F.col("id").alias("place"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    blocks = _blocks(_listed(equal, None, 1), 100).select(F.size("rows").alias("n")).collect()
    assert len(blocks) > 20 and max(b.n for b in blocks) < 200 and sum(b.n for b in blocks) == 3000


def test_mentions_without_a_surface(spark):
    got = run(spark, [(None, "ORG"), ("Acme", "ORG"), ("Acme", None)])
    assert [r.name for r in got.entities.filter("type = 'ORG'").collect()] == ["Acme"]
