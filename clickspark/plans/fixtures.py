"""Stand-in exposures, ads, profiles and behaviours derived from the given tables; the same SQL serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXPOSURES = """
select event_id, user_id as user_key, ts, {K} as adgroup_id, case when event_id % 2 = 0 then 'p0' else 'p1' end as pid,
       case when event_type = 'click' then 1 else 0 end as clk
from {events} where event_type in ('view', 'click')"""

_ADS = """
select p_partkey as adgroup_id, p_size as cate_id,
       case when p_size % 7 = 0 then null else cast(replace(p_brand, 'Brand#', '') as bigint) end as brand,
       p_retailprice as price, p_type as campaign_id
from {part} where p_partkey % 10 <> 0"""

_PROFILES = """
select c_custkey as userid, c_nationkey as cms_segid, c_nationkey % 13 as cms_group_id, 1 + c_custkey % 2 as final_gender_code,
       c_custkey % 7 as age_level, case when c_custkey % 2 = 0 then null else 1 + c_custkey % 3 end as pvalue_level,
       1 + c_custkey % 3 as shopping_level, case when c_mktsegment = 'HOUSEHOLD' then 1 else 0 end as occupation,
       case when c_custkey % 3 = 0 then null else 1 + c_custkey % 4 end as new_user_class_level
from {customer} where c_custkey % 8 <> 0"""

_BEHAVIORS = """
select e.event_id, e.user_id as user_key, e.ts, case when e.event_type = 'purchase' then 'buy' else 'pv' end as btag, k as item,
       p_size as cate, case when p_size % 7 = 0 then null else cast(replace(p_brand, 'Brand#', '') as bigint) end as brand
from (select event_id, user_id, ts, event_type, {K} as k from {events} where event_type in ('signup', 'purchase', 'error')) e
join {part} on p_partkey = e.k"""

_SPARK_KEY = "cast(get_json_object(props, '$.k') as bigint)"
_ORACLE_KEY = "cast(json_extract_string(props, '$.k') as bigint)"


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, merged: str | None = None) -> DataFrame:
    """`merged` names a table that is joined by sorting and merging, so that it never passes through the driver."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql.replace("{K}", _SPARK_KEY), **{t: df.hint("merge") if t == merged else df for t, df in read.items()})


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _EXPOSURES, "events")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _ADS, "part")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _PROFILES, "customer")


def behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _BEHAVIORS, "events", "part", merged="part")


def oracle_views() -> str:
    """The same tables as the beginning of a WITH list."""
    views = {"exposures": _EXPOSURES, "ads": _ADS, "profiles": _PROFILES, "behaviors": _BEHAVIORS}
    filled = {n: s.replace("{K}", _ORACLE_KEY).replace("{events}", "events").replace("{part}", "part").replace("{customer}", "customer") for n, s in views.items()}
    return ", ".join(f"{n} as ({s})" for n, s in filled.items())
