"""Keyed tables against the plain plans over whole tables."""

import pytest
from pyspark.sql import functions as F

from tidemill.errors import ConflictError
from tidemill.operators import tables
from tidemill.sources.keyed import KeyedTable, bump

SCHEMA = "id long, name string, n long, made string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], buckets=16)


def rows(spark, ids, name, n=None, made="old"):
    return spark.createDataFrame([(i, f"{name}{i}", n, made) for i in ids], SCHEMA)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mutations_equal_the_plans_over_whole_tables(spark, table):
    whole = rows(spark, range(500), "a", 1)
    table.replace(whole, ["name"])
    assert held(table.read()) == held(whole)
    batch = rows(spark, range(450, 520), "b", None, "new")
    table.merge(batch, ["name"], {"made": F.lit("new")})
    whole = tables.merge_rows(whole, batch, ["id"], ["name"], {"made": F.lit("new")})
    assert held(table.read()) == held(whole)
    more = rows(spark, [3, 600, 600, 601], "c", 7)
    table.insert(more, ["name"])
    whole = tables.insert_if_absent(whole, more, ["id"], ["name"])
    assert held(table.read()) == held(whole)
    gone = spark.createDataFrame([(3,), (4,), (9999,)], "id long")
    table.delete(gone)
    whole = tables.delete_ids(whole, gone, "id")
    assert held(table.read()) == held(whole)
    table.replace(rows(spark, [4], "back", 5), ["name"])
    whole = whole.unionByName(rows(spark, [4], "back", 5))
    assert held(table.read()) == held(whole)
    assert held(table.lookup(spark.createDataFrame([(4,), (3,), (470,)], "id long"))) == held(whole.filter("id IN (3, 4, 470)"))
    table.compact()
    assert not table.manifest().deltas and held(table.read()) == held(whole)


def test_a_small_batch_writes_its_own_rows_and_compaction_the_touched_buckets(spark, table):
    table.replace(rows(spark, range(5000), "a", 1), ["name"])
    table.compact()
    before = table.manifest()
    assert len(before.base) == 16 and before.base_rows == 5000
    table.merge(rows(spark, range(5), "b", 2), ["name"])
    after = table.manifest()
    assert after.base == before.base and [d["rows"] for d in after.deltas] == [5]
    touched = {str(b) for b in after.deltas[0]["buckets"]}
    assert len(touched) <= 5
    table.compact()
    last = table.manifest()
    assert {b for b in last.base if last.base[b] != before.base[b]} == touched
    assert table.read().filter("n = 2").count() == 5 and table.read().count() == 5000


def test_readers_keep_their_version_and_expiry_spares_used_files(spark, table):
    table.replace(rows(spark, range(100), "a", 1), ["name"])
    first = table.version()
    old = table.read()
    table.replace(rows(spark, range(50), "b", 2), ["name"])
    assert old.filter("n = 2").count() == 0 and table.read(first).filter("n = 2").count() == 0
    table.expire(keep=1)
    assert table.read().filter("n = 2").count() == 50 and table.read().count() == 100
    assert table.manifest(table.version()).version == table.version()


def test_two_writers_get_versions_one_after_the_other(spark, table, monkeypatch):
    other = KeyedTable(spark, table.folder, SCHEMA, ["id"], buckets=16)
    table.replace(rows(spark, range(100), "a", 1), ["name"])
    table.compact()
    seen = table.manifest()
    other.replace(rows(spark, [1], "theirs", 2), ["name"])
    with monkeypatch.context() as m:
        m.setattr(table, "manifest", lambda version=None: seen)
        with pytest.raises(ConflictError):
            table.replace(rows(spark, [2], "ours", 3), ["name"])
    version = bump(table, lambda t: t.replace(rows(spark, [2], "ours", 3), ["name"]))
    assert version == other.version() == seen.version + 2
    assert table.lookup(spark.createDataFrame([(1,), (2,)], "id long")).count() == 2
    assert {r.name for r in table.read().filter("n > 1").collect()} == {"theirs1", "ours2"}


def test_a_manifest_that_was_lost_half_written_is_passed_over(spark, table, monkeypatch):
    table.replace(rows(spark, range(10), "a", 1), ["name"])
    version = table.version()
    fs, where = table._files(f"{table.folder}/manifests/v{version + 1}")
    fs.create(where, False).close()
    assert table.version() == version and table.read().count() == 10
    with pytest.raises(ConflictError):
        table.replace(rows(spark, [1], "b", 2), ["name"])
    monkeypatch.setattr("tidemill.sources.keyed.PATIENCE", 0)
    assert table.replace(rows(spark, [1], "b", 2), ["name"]) >= version + 2
    assert table.read().filter("n = 2").count() == 1


def test_an_empty_table_and_an_empty_batch(spark, table):
    assert table.read().count() == 0 and table.version() == 0
    assert table.replace(table.empty, ["name"]) == 0
    assert table.delete(spark.createDataFrame([(1,)], "id long")) == 0
