"""What a query needs on disk only for a while goes when it has been used."""

import datetime
import json
import os
import time

from adatlas.operators import answers as A
from adatlas.operators import report as R
from adatlas.plans import registry
from adatlas.streaming.answers import follow


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f for f in files if os.path.basename(f).startswith("shuffle_")}


def gone(spark, before):
    """Whether no shuffle file is left beside those that were there; they are deleted in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return not left


def lines(n=60):
    """Order lines and parts as the given tables have them."""
    row = lambda k: (k, k % 5 + 1, k % 2 + 1, k % 7, float(k), float(k * 10), 0.05, 0.02, "ARN"[k % 3], "OF"[k % 2], datetime.datetime(2020, 1, 1))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    return [row(k) for k in range(n)], kinds, [(k, f"name{k} of part", k) for k in range(1, 6)], "p_partkey long, p_name string, p_size int"


def given(spark, folder):
    rows, kinds, parts, part_kinds = lines()
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, part_kinds).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_a_stream_drops_what_its_batches_were_dealt_by(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    before = shuffle_files(spark)
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"issue_id": "i", "spread_no": s, "page_nums": [1], "raw": "{}", "signature": f"s{s}"}) for s in range(40)))
        follow(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert gone(spark, before)
    assert spark.read.parquet(str(tmp_path / "out/answers")).count() == 40


def test_sent_answers_go_once_they_are_read(spark, tmp_path, monkeypatch):
    seen = []

    def followed(session, source, *rest):
        seen.append({f for f in os.listdir(source.removeprefix("file://")) if f.startswith("part-")})
        return follow(session, source, *rest)

    monkeypatch.setattr(registry, "follow", followed)
    got = registry.streamed_answers(spark, given(spark, tmp_path)).collect()
    assert sum(r.answers for r in got) == 60 and len(seen) == 3
    assert not (seen[0] & seen[1] or seen[0] & seen[2] or seen[1] & seen[2])
    assert all(f.endswith(".gz") for files in seen for f in files)


def test_whole_issues_are_dealt_once(spark):
    rows = [(i, f"Brand {k % 7}{', S.A.' if k % 2 else ''}", k, "w" if k % 3 else "", "", "", "", "", k / 100, "ia", "") for i in (1, 2) for k in range(30)]
    ads = spark.createDataFrame(rows, "issue_id long, brand string, page_no int, website string, email string, phone string, sector string, ad_size string, confidence double, method string, notes string")
    usual, once = (R.indexed(A.merged(ads, ["page_no"], **how)) for how in ({}, {"dealt": ("issue_id",)}))
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, usual.collect())) == sorted(map(str, once.collect()))


def test_objects_are_small_and_what_they_were_dealt_by_goes(spark, tmp_path, monkeypatch):
    before, kept = shuffle_files(spark), registry.kept_result

    def asked(result, *folders):
        files = [f for folder in folders for f in os.listdir(folder.removeprefix("file://")) if f.startswith("part-")]
        assert files and all(f.endswith(".json.gz") for f in files) and gone(spark, before)
        return kept(result, *folders)

    monkeypatch.setattr(registry, "kept_result", asked)
    got = registry.json_objects(spark, given(spark, tmp_path)).collect()
    assert [(r.issue_id, r.titulo, len(r.ads.split("|"))) for r in sorted(got)] == [(12020, "Revista", 5), (22020, "Revista", 5)]
