"""An export with its library computes its input once, however often it is asked for."""

import pytest
from pyspark.sql import functions as F

from adatlas.plans import registry
from adatlas.sources.stored_library import Library
from tests.test_disk import given


def test_an_export_computes_its_input_once(spark, tmp_path, monkeypatch):
    seen, own = spark.sparkContext.accumulator(0), registry.numbered_ads

    @F.udf("string")
    def counted(b):
        seen.add(1)
        return b

    monkeypatch.setattr(registry, "numbered_ads", lambda *a: own(*a).withColumn("brand", counted.asNondeterministic()("brand")))
    got = registry.exported_once(spark, given(spark, tmp_path)).collect()
    assert sorted((r.issue_id, r.n, r.stored) for r in got) == [(12020, 5, 5), (22020, 5, 5)]
    assert seen.value == 10


def test_a_broken_library_is_found_before_anything_is_written(spark, tmp_path):
    (tmp_path / "lib/log/0000000001.json").mkdir(parents=True)
    ads = spark.createDataFrame([(1, "Acme", "", 0.5)], "issue_id long, brand string, sector string, confidence double")
    meta = spark.createDataFrame([(1, "R", "12", 0.0)], "issue_id long, titulo string, paginas string, coste_usd double")
    with pytest.raises(Exception):
        Library(spark, str(tmp_path / "lib")).save(meta, ads)
    assert not (tmp_path / "lib/data").exists()
