"""Readers and writers."""

import shutil

import pytest

from pyspark.sql import functions as F

from clickspark import schemas, sources
from clickspark.operators import lookup, sequences


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "profile.csv").write_text("userid,cms_segid,cms_group_id,final_gender_code,age_level,pvalue_level,shopping_level,occupation,new_user_class_level \n1,2,3,1,4,,3,0,2\n")
    row = sources.read_profiles(spark, str(tmp_path / "profile.csv")).first()
    assert row["new_user_class_level"] == 2 and row["pvalue_level"] is None
    (tmp_path / "ads.csv").write_text("adgroup_id,cate_id,campaign_id,customer,brand,price\n1,2,3,4,,NaN\n2,2,3,4,5,1.5\n")
    ads = sources.read_ads(spark, str(tmp_path / "ads.csv"))
    assert [(r["brand"], r["price"]) for r in ads.orderBy("adgroup_id").collect()] == [(None, None), (5, 1.5)]
    (tmp_path / "expo.csv").write_text("user,time_stamp,adgroup_id,pid,nonclk,clk\n1,1494000000,7,p,1,0\n2,1494000001,7,p,0,1\n")
    expo = sources.read_exposures(spark, str(tmp_path / "expo.csv"))
    assert expo.schema == schemas.EXPOSURES and expo.count() == 2
    assert sources.read_exposures(spark, str(tmp_path / "expo.csv"), max_rows=1).count() == 1
    sources.write_sample(expo, str(tmp_path / "out"), "csv")
    back = sources.read_table(spark, str(tmp_path / "out"), "csv", schemas.EXPOSURES)
    assert back.exceptAll(expo).count() == 0 and back.columns == expo.columns
    sources.write_sample(expo, str(tmp_path / "parts"), partition_by="pid")
    assert (tmp_path / "parts" / "pid=p").exists() and sources.read_table(spark, str(tmp_path / "parts")).count() == 2


def test_headers_and_unique_keys(spark):
    assert sources.clean_headers(spark.createDataFrame([(1, 2)], "` a ` int, `b ` int")).columns == ["a", "b"]
    rows = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    with pytest.raises(ValueError, match="k = 1 occurs 2 times"):
        sources.check_unique(rows, "k")
    assert sources.check_unique(rows.distinct(), "k").count() == 2


def test_prepared_log(spark, tmp_path):
    log = spark.createDataFrame([(1, 5, "pv", 1, 1), (1, 4, "pv", 2, None), (2, 1, "pv", 3, 1), (1, 3, "buy", 4, 1)], schemas.BEHAVIORS)
    users = spark.createDataFrame([(1,), (1,)], "user long")
    found = sources.materialize_behaviors(log, users, str(tmp_path / "log"))
    assert sorted(r["cate"] for r in found.collect()) == [1, 2]
    again = sources.materialize_behaviors(log, users, str(tmp_path / "log"))
    assert again.inputFiles() == found.inputFiles()
    others = sources.materialize_behaviors(log, spark.createDataFrame([(2,)], "user long"), str(tmp_path / "log"))
    assert [r["cate"] for r in others.collect()] == [3]
    for folder in (tmp_path / "log").iterdir():  # as if the writes had not ended
        shutil.move(folder / "done", tmp_path / f"done of {folder.name}")
        next((folder / "rows").glob("part-*")).unlink()
    assert sorted(r["cate"] for r in sources.materialize_behaviors(log, users, str(tmp_path / "log")).collect()) == [1, 2]
    log.write.parquet(str(tmp_path / "raw"))
    assert sources.read_behaviors(spark, str(tmp_path / "raw"), ["user", "cate"]).columns == ["user", "cate"]


def _under_exchanges(df):
    """The part of a plan that stands below some exchange."""
    lines, out, depth = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth is not None and indent <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "Exchange" in line:
            depth = indent
    return "\n".join(out)


@pytest.fixture
def prepared(spark, tmp_path):
    """A log and exposures in files."""
    spark.range(3000).selectExpr("id as event_id", "id % 37 as user_key", "id * 7 % 1000 as ts", "if(id % 5 = 0, 'buy', 'pv') as btag", "id % 11 as cate").write.parquet(str(tmp_path / "raw"))
    spark.range(400).selectExpr("id as event_id", "id % 41 as user_key", "id * 13 % 1000 as ts").write.parquet(str(tmp_path / "shown"))
    return spark.read.parquet(str(tmp_path / "raw")), spark.read.parquet(str(tmp_path / "shown"))


def test_a_log_in_buckets_is_not_shuffled(spark, tmp_path, prepared):
    """Joins, windows and groups by user read the buckets as they are, and give what the plain log gives."""
    log, shown = prepared
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = sources.materialize_behaviors(log, shown, str(tmp_path / "log"), "user_key", "ts", buckets=4)
        plain = log.where("btag = 'pv'").join(shown.select("user_key").distinct(), "user_key", "left_semi")
        pairs = [
            (lookup.restrict_to_users(told, shown.repartition(4, "user_key")), lookup.restrict_to_users(plain, shown)),
            (sequences.asof_history(shown, told, ["cate"], 3, buckets=4), sequences.asof_history(shown, plain, ["cate"], 3)),
            (sequences.prior_count(shown, told, buckets=4), sequences.prior_count(shown, plain)),
        ]
        for ours, theirs in pairs:
            assert "prepared_log" in ours._jdf.queryExecution().executedPlan().toString() and "prepared_log" not in _under_exchanges(ours)
            assert sorted(map(str, ours.select(*sorted(ours.columns)).collect())) == sorted(map(str, theirs.select(*sorted(theirs.columns)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prepared_logs_are_told_by_their_files(spark, tmp_path, prepared):
    """The same files and plan are written once, in any session; other files, plans and users are never served the older rows."""
    log, shown = prepared
    make = lambda a, b, **more: sources.materialize_behaviors(a, b, str(tmp_path / "log"), "user_key", "ts", buckets=4, **more)
    first = make(log, shown)
    before = {f: (tmp_path / "log" / f).stat().st_mtime_ns for f in [p.name for p in (tmp_path / "log").iterdir()]}
    spark.sql(f"drop table {[t.name for t in spark.catalog.listTables() if t.name.startswith('prepared_log')][-1]}")  # as a new session sees it
    again = make(spark.read.parquet(str(tmp_path / "raw")), shown)
    assert again.exceptAll(first).count() == 0 and again.count() == first.count() == 2400 and len(before) == len(list((tmp_path / "log").iterdir()))
    assert make(log.where("ts < 500"), shown).count() < first.count()
    assert make(log, shown.where("user_key < 3")).select("user_key").distinct().count() == 3
    spark.range(5000, 5100).selectExpr("id as event_id", "id % 37 as user_key", "id as ts", "'pv' as btag", "id % 11 as cate").write.mode("append").parquet(str(tmp_path / "raw"))
    assert make(spark.read.parquet(str(tmp_path / "raw")), shown).count() == 2500
    assert make(spark.read.parquet(str(tmp_path / "raw")), shown, btag=None).where(F.col("btag") == "buy").count() == 600
