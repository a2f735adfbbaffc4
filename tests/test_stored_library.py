import pytest
from pyspark.sql import functions as F

from adatlas.sources.stored_library import Library


def issue(spark, *ids):
    return spark.createDataFrame([(i, f"T{i}", "12", 0.0) for i in ids], "issue_id long, titulo string, paginas string, coste_usd double")


def ads(spark, *rows):
    return spark.createDataFrame([(*r, "Bebidas", None) for r in rows], "issue_id long, brand string, sector string, confidence double")


def brands(lib, version=None):
    return sorted((r.issue_id, r.brand) for r in lib.read("advertisers", version).collect())


@pytest.fixture
def lib(spark, tmp_path):
    made = Library(spark, f"{tmp_path}/lib")
    assert made.read("issues") is None and made.version() == 0
    made.save(issue(spark, 1, 2), ads(spark, (1, "a"), (1, "b"), (2, "c")), save_id="one")
    return made


def test_a_repeated_save_adds_nothing_and_old_versions_stay(spark, lib):
    assert not lib.save(issue(spark, 1, 2), ads(spark, (1, "a")), save_id="one")
    assert lib.save(issue(spark, 3), ads(spark, (3, "d")))
    assert brands(lib) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")] and brands(lib, 1) == [(1, "a"), (1, "b"), (2, "c")]
    assert sorted((r.issue_id, r.n_anunciantes) for r in lib.read("issues").collect()) == [(1, 2), (2, 1), (3, 1)]


def test_deleting_rewrites_only_folders_that_hold_the_issues(spark, lib):
    lib.save(issue(spark, 3), ads(spark, (3, "d")))
    before = {f["path"] for f in lib.state()["tables"]["advertisers"]["folders"]}
    assert lib.delete(issue(spark, 2, 9)) and not lib.delete(issue(spark, 2, 9))
    after = {f["path"] for f in lib.state()["tables"]["advertisers"]["folders"]}
    assert brands(lib) == [(1, "a"), (1, "b"), (3, "d")] and len(before - after) == 1
    assert sorted(r.issue_id for r in lib.read("issues").collect()) == [1, 3]


def test_changes_that_broke_off_are_invisible_and_tidied(spark, lib):
    lib._write("advertisers", ads(spark, (7, "x")))
    assert brands(lib) == [(1, "a"), (1, "b"), (2, "c")]
    assert lib.tidy() == 1 and lib.tidy() == 0 and brands(lib) == [(1, "a"), (1, "b"), (2, "c")]


def test_a_change_begins_anew_where_another_came_first(spark, lib):
    other, publish, first = Library(spark, lib.root), lib._publish, []

    def late(state):
        if not first:
            first.append(other.save(issue(spark, 4), ads(spark, (4, "e"))))
        return publish(state)

    lib._publish = late
    assert lib.save(issue(spark, 5), ads(spark, (5, "f"))) and lib.version() == 3
    assert brands(lib)[-2:] == [(4, "e"), (5, "f")]


def test_migrating_files_from_before(spark, lib, tmp_path):
    spark.createDataFrame([(8, "z", "Queso", "z")], "issue_id long, brand string, sector string, canonical string").write.parquet(f"{tmp_path}/old")
    lib.adopt("advertisers", f"{tmp_path}/old")
    assert lib.read("advertisers").where("issue_id = 8").first().sector_group is None
    assert lib.migrate() and not lib.migrate()
    assert {r.issue_id: r.sector_group for r in lib.read("advertisers").collect()} == {1: "Bebidas", 2: "Bebidas", 8: "Alimentacion"}
    assert lib.delete(issue(spark, 8)) and lib.read("advertisers").where(F.col("issue_id") == 8).count() == 0


def test_empty_saves(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/lib")
    assert lib.save(issue(spark, 1).limit(0), ads(spark, (1, "a")).limit(0))
    assert lib.read("advertisers").count() == 0 and not lib.delete(issue(spark, 1)) and not lib.migrate()
