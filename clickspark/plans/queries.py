"""The registered queries of the click-log operators, each beside its SQL. Doubles are rounded to six places, arrays are
comma-joined texts and dates are texts, so that both engines print alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import LOCAL_ZONE, dot, epoch_to_ntz, field_of, local_time, logistic, mask, minus, smoothed_rate, times
from ..operators import attention, clean, encode, history, interest, lookup, metrics, models, profile, sequences, split
from ..sources.shared import shared_folder
from . import fixtures, samples

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = f"with {fixtures.oracle_views()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _r(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


def _joined(c: str, name: str | None = None) -> Column:
    """A list as text, missing items as an empty text."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",").alias(name or c)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.wide(fixtures.exposures(spark, sf_dir), fixtures.ads(spark, sf_dir), fixtures.profiles(spark, sf_dir))


_WIDE = """+ wide as (select e.*, a.cate_id, a.brand, a.price, a.campaign_id, p.cms_segid, p.cms_group_id, p.final_gender_code, p.age_level,
  p.pvalue_level, p.shopping_level, p.occupation, p.new_user_class_level
  from exposures e left join ads a using (adgroup_id) left join profiles p on e.user_key = p.userid)"""
_DATED = _WIDE + ", dated as (select *, strftime(ts + interval 8 hour, '%Y-%m-%d') as date from wide)"
_LOG = """+ logs as (select *, row_number() over (partition by user_key order by ts, event_id) as r from behaviors),
  seen as (select e.event_id, e.user_key, e.adgroup_id, e.ts, l.item, l.cate, l.brand, l.r, row_number() over (partition by e.event_id order by l.r desc) as back
  from exposures e join logs l on l.user_key = e.user_key and l.ts < e.ts)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).withColumn("date", F.date_format(local_time(F.col("ts"), LOCAL_ZONE), "yyyy-MM-dd"))


def _hist(spark: SparkSession, sf_dir: str, n: int = 20, plan=sequences.asof_history) -> DataFrame:
    return plan(fixtures.exposures(spark, sf_dir), fixtures.behaviors(spark, sf_dir), ["item", "cate", "brand"], n)


# --- lookups and cleaning


@_query(_WIDE + """ select event_id, user_key, adgroup_id, pid, clk, cate_id, brand, round(price, 6) as price, campaign_id, cms_segid, cms_group_id, final_gender_code,
  age_level, pvalue_level, shopping_level, occupation, new_user_class_level from wide""")
def exposures_wide(spark, sf_dir):
    return _wide(spark, sf_dir).drop("ts").withColumn("price", F.round("price", 6))


@_query(_WIDE + " select event_id, clk, pid, cate_id, campaign_id, round(price, 6) as price from wide")
def keep_and_drop_columns(spark, sf_dir):
    kept = clean.keep_columns(_wide(spark, sf_dir), ["event_id", "clk", "pid", "cate_id", "campaign_id", "price", "ts"])
    return clean.drop_columns(kept, ["ts"]).withColumn("price", F.round("price", 6))


@_query(_WIDE + """ select event_id, coalesce(brand, -1) as brand, coalesce(pvalue_level, -1) as pvalue_level, coalesce(new_user_class_level, -1) as new_user_class_level from wide""")
def fill_unknown(spark, sf_dir):
    names = ["brand", "pvalue_level", "new_user_class_level"]
    return clean.fill_unknown(_wide(spark, sf_dir), names).select("event_id", *names)


@_query(_WIDE + """ select event_id, coalesce(brand, -1) + 1 as brand, coalesce(pvalue_level, -1) + 1 as pvalue_level, coalesce(new_user_class_level, -1) + 1 as new_user_class_level from wide""")
def shift_unknown(spark, sf_dir):
    names = ["brand", "pvalue_level", "new_user_class_level"]
    return clean.shift_unknown(clean.fill_unknown(_wide(spark, sf_dir), names), names).select("event_id", *names)


@_query(" select event_id, user_key, cate, brand from behaviors where btag = 'pv'")
def filter_btag(spark, sf_dir):
    return clean.filter_btag(fixtures.behaviors(spark, sf_dir)).select("event_id", "user_key", "cate", "brand")


@_query(" select event_id, user_key from behaviors where user_key in (select userid from profiles)")
def filter_members(spark, sf_dir):
    members = fixtures.profiles(spark, sf_dir).withColumnRenamed("userid", "user_key")
    return clean.filter_members(fixtures.behaviors(spark, sf_dir), members, "user_key").select("event_id", "user_key")


@_query(""" select event_id, extract(hour from ts + interval 8 hour) as hour, isodow(ts + interval 8 hour) - 1 as weekday,
  strftime(ts + interval 8 hour, '%Y-%m-%d') as date from exposures""")
def time_parts_local(spark, sf_dir):
    out = clean.add_time_parts(fixtures.exposures(spark, sf_dir), "ts", LOCAL_ZONE)
    return out.select("event_id", F.col("hour").cast("long").alias("hour"), F.col("weekday").cast("long").alias("weekday"), F.col("date").cast("string").alias("date"))


@_query(" select event_id, extract(hour from ts) as hour, isodow(ts) - 1 as weekday, strftime(ts, '%Y-%m-%d') as date from exposures")
def time_parts_utc(spark, sf_dir):
    out = clean.add_time_parts(fixtures.exposures(spark, sf_dir), "ts")
    return out.select("event_id", F.col("hour").cast("long").alias("hour"), F.col("weekday").cast("long").alias("weekday"), F.col("date").cast("string").alias("date"))


@_query(_DATED + """ select 'equals' as predicate, count(*) as n from dated where date = '2024-01-08' union all select 'in', count(*) from dated where date in ('2024-01-08', '2024-01-09')
  union all select 'not', count(*) from dated where date not in ('2024-01-08', '2024-01-09')""")
def date_predicates(spark, sf_dir):
    rows, days = _dated(spark, sf_dir), ["2024-01-08", "2024-01-09"]
    parts = {"equals": clean.date_equals(rows, days[0]), "in": clean.date_in(rows, days), "not": clean.date_not(rows, days)}
    out = None
    for name, part in parts.items():
        counted = part.agg(F.lit(name).alias("predicate"), F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


@_query(_WIDE + " select event_id, coalesce(lag(clk) over (partition by user_key order by ts, event_id), 0) as last_clk from wide")
def fill_zero_history(spark, sf_dir):
    last = F.lag("clk").over(Window.partitionBy("user_key").orderBy("ts", "event_id"))
    return clean.fill_zero_history(_wide(spark, sf_dir).withColumn("last_clk", last), ["last_clk"]).select("event_id", "last_clk")


@_query(""" select a.vec_id, round(list_sum([a.embedding[i]::double - b.embedding[i]::double for i in generate_series(1, len(a.embedding))]), 5) as difference,
  round(list_sum([a.embedding[i]::double * b.embedding[i]::double for i in generate_series(1, len(a.embedding))]), 5) as product, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 5) as dot
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_functions(spark, sf_dir):
    told = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = told.join(told.select((F.col("vec_id") - 1).alias("_id"), F.col("v").alias("w")), F.col("vec_id") == F.col("_id"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), 5)
    v, w = F.col("v"), F.col("w")
    return pairs.select("vec_id", total(minus(v, w)).alias("difference"), total(times(v, w)).alias("product"), F.round(dot(v, w), 5).alias("dot"))


@_query(""" select event_id, round((clk + 0.25) / (event_id % 9 + 5.0), 6) as rate, round(1 / (1 + exp(-(event_id % 11 - 5.0))), 6) as chance,
  strftime(timestamp '1970-01-01' + to_seconds(1494000000 + event_id), '%Y-%m-%d %H:%M:%S') as at from exposures""")
def scalar_functions(spark, sf_dir):
    n = F.col("event_id")
    return fixtures.exposures(spark, sf_dir).select(
        "event_id", _r(smoothed_rate(F.col("clk"), n % 9, 0.25, 5.0), "rate"), _r(logistic(n % 11 - F.lit(5.0)), "chance"),
        F.date_format(epoch_to_ntz(F.lit(1494000000) + n), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


# --- point-in-time counters


def _counter_sql(prefix: str, key: str, a: float, b: float, frame: str = "rows between unbounded preceding and 1 preceding", order: str = "ts, event_id") -> str:
    w = f"(partition by {key} order by {order} {frame})"
    missing = " or ".join(f"{k.strip()} is null" for k in key.split(","))
    return f"""{_WIDE} , c as (select event_id, case when {missing} then null else count(*) over {w} end as imp,
      case when {missing} then 0 else coalesce(sum(clk) over {w}, 0) end as k from wide)
      select event_id, cast(imp as bigint) as {prefix}_hist_imp, cast(k as bigint) as {prefix}_hist_clk, round((k + {a}) / (imp + {b}), 6) as {prefix}_hist_ctr from c"""


def _counters(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("event_id", f"{prefix}_hist_imp", f"{prefix}_hist_clk", _r(f"{prefix}_hist_ctr"))


_ORDER = ["ts", "event_id"]


def _local_day() -> Column:
    return F.to_date(local_time(F.col("ts"), LOCAL_ZONE))


@_query(_counter_sql("ad", "adgroup_id", 0.5, 10.0))
def hist_ad(spark, sf_dir):
    return _counters(history.history(_wide(spark, sf_dir), ["adgroup_id"], "ad", _ORDER, a=0.5, b=10.0), "ad")


@_query(_counter_sql("user", "user_key", 0.25, 5.0))
def hist_user(spark, sf_dir):
    return _counters(history.history(_wide(spark, sf_dir), ["user_key"], "user", _ORDER), "user")


@_query(_counter_sql("user_cate", "user_key, cate_id", 0.25, 5.0))
def hist_user_cate(spark, sf_dir):
    return _counters(history.history(_wide(spark, sf_dir), ["user_key", "cate_id"], "user_cate", _ORDER), "user_cate")


@_query(_counter_sql("ad", "adgroup_id", 0.5, 10.0))
def hist_ad_by_day(spark, sf_dir):
    """The same by windows over one day of a key each."""
    return _counters(history.history_by_day(_wide(spark, sf_dir), ["adgroup_id"], "ad", _ORDER, _local_day(), a=0.5, b=10.0), "ad")


@_query(_counter_sql("ad", "adgroup_id", 0.5, 10.0, "range between unbounded preceding and interval 1 microsecond preceding", "ts"))
def hist_ad_strict(spark, sf_dir):
    return _counters(history.history_strict(_wide(spark, sf_dir), ["adgroup_id"], "ad", "ts", a=0.5, b=10.0), "ad")


@_query("""+ li as (select *, case when l_returnflag = 'R' then 1 else 0 end as clk from lineitem),
  d as (select l_partkey, l_shipdate, count(*) as n, sum(clk) as c from li group by 1, 2),
  p as (select l_partkey, l_shipdate, coalesce(sum(n) over w, 0) as imp, coalesce(sum(c) over w, 0) as k from d
        window w as (partition by l_partkey order by l_shipdate rows between unbounded preceding and 1 preceding))
  select l_partkey, l_orderkey, l_linenumber, round(l_extendedprice, 6) as l_extendedprice, cast(imp as bigint) as part_hist_imp, cast(k as bigint) as part_hist_clk,
         round((k + 0.25) / (imp + 5.0), 6) as part_hist_ctr from li join p using (l_partkey, l_shipdate)""")
def hist_strict_lineitem(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumn("clk", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    out = history.history_strict(rows, ["l_partkey"], "part", "l_shipdate")
    return out.select("l_partkey", "l_orderkey", "l_linenumber", _r("l_extendedprice"), "part_hist_imp", "part_hist_clk", _r("part_hist_ctr"))


# --- behaviour sequences


@_query(" select event_id, user_key, btag, cate, brand from behaviors where user_key in (select user_key from exposures)")
def restrict_to_users(spark, sf_dir):
    return lookup.restrict_to_users(fixtures.behaviors(spark, sf_dir), fixtures.exposures(spark, sf_dir)).select("event_id", "user_key", "btag", "cate", "brand")


def _asof_sql(n: int) -> str:
    return f"""{_LOG} select e.event_id, coalesce(string_agg(s.cate::varchar, ',' order by s.r), '') as cates,
      coalesce(string_agg(coalesce(s.brand::varchar, ''), ',' order by s.r), '') as brands, cast(count(s.r) as bigint) as seq_len
      from exposures e left join seen s on s.event_id = e.event_id and s.back <= {n} group by e.event_id"""


def _asof(df: DataFrame) -> DataFrame:
    out = df.withColumns({"cates": field_of(F.col("hist"), "cate"), "brands": field_of(F.col("hist"), "brand")})
    return out.select("event_id", _joined("cates"), _joined("brands"), F.col("seq_len").cast("long").alias("seq_len"))


@_query(_asof_sql(5))
def asof_history_simple(spark, sf_dir):
    return _asof(_hist(spark, sf_dir, 5, sequences.asof_history_simple))


@_query(_asof_sql(20))
def asof_history_block(spark, sf_dir):
    return _asof(_hist(spark, sf_dir, 20))


@_query(_asof_sql(20))
def asof_history_bucketed(spark, sf_dir):
    """The same from a log in buckets by user, which is read without a shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    exposures = fixtures.exposures(spark, sf_dir)
    log = sources.materialize_behaviors(fixtures.behaviors(spark, sf_dir), exposures, f"{shared_folder(spark)}/prepared-log", "user_key", "ts", None, n)
    return _asof(sequences.asof_history(exposures, log, ["cate", "brand"], 20, buckets=n))


@_query(_LOG + " select e.event_id, cast(count(s.r) as bigint) as n_prior from exposures e left join seen s using (event_id) group by e.event_id")
def prior_count(spark, sf_dir):
    return sequences.prior_count(fixtures.exposures(spark, sf_dir), fixtures.behaviors(spark, sf_dir))


@_query(f""" select user_key, cast(floor((r - 1) / {sequences.LOG_BLOCK}) as bigint) as block, string_agg(cate::varchar, ',' order by ts, event_id) as cates,
  cast(count(*) as bigint) as n from (select *, row_number() over (partition by user_key order by ts, event_id) as r from behaviors) group by all""")
def collect_user_log(spark, sf_dir):
    out = sequences.collect_user_log(fixtures.behaviors(spark, sf_dir), ["cate"])
    return out.withColumn("cates", field_of(F.col("log"), "cate")).select("user_key", "block", _joined("cates"), F.size("log").cast("long").alias("n"))


# --- profiling


@_query(""" select round(avg(case when userid is null then 0 else 1 end), 6) as row_share,
  round(count(distinct case when userid is not null then user_key end) * 1.0 / count(distinct user_key), 6) as key_share from exposures left join profiles on user_key = userid""")
def coverage_rows_and_keys(spark, sf_dir):
    return lookup.coverage(fixtures.exposures(spark, sf_dir), fixtures.profiles(spark, sf_dir), "user_key", "userid").select(_r("row_share"), _r("key_share"))


@_query(" select pid, count(clk) as n, round(avg(clk), 6) as ctr from exposures group by pid")
def ctr_by_slot(spark, sf_dir):
    return profile.ctr_by(fixtures.exposures(spark, sf_dir), "pid").select("pid", "n", _r("ctr"))


@_query(_DATED + " select date, count(clk) as n, round(avg(clk), 6) as ctr from dated group by date")
def ctr_by_date(spark, sf_dir):
    return profile.ctr_by(_dated(spark, sf_dir), "date").select("date", "n", _r("ctr"))


@_query(" select btag as value, count(*) as n, round(count(*) * 1.0 / (select count(*) from behaviors), 6) as share from behaviors group by btag")
def value_counts_btag(spark, sf_dir):
    return profile.value_counts(fixtures.behaviors(spark, sf_dir), "btag", dropna=False).select("value", "n", _r("share"))


@_query(" select brand as value, count(*) as n, round(count(*) * 1.0 / (select count(brand) from behaviors), 6) as share from behaviors where brand is not null group by brand")
def value_counts_brand(spark, sf_dir):
    return profile.value_counts(fixtures.behaviors(spark, sf_dir), "brand").select("value", "n", _r("share"))


@_query(" select count(*) as n_rows, count(distinct user_key) as n_user_key, count(distinct adgroup_id) as n_adgroup_id, count(distinct pid) as n_pid from exposures")
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(fixtures.exposures(spark, sf_dir), ["user_key", "adgroup_id", "pid"])


@_query(" select count(*) as n_rows, true as near_user_key, true as near_adgroup_id, true as near_pid from exposures")
def distinct_sketches(spark, sf_dir):
    """Distinct values from sketches of each day, united: within 5 % of the exact counts."""
    rows, names = fixtures.exposures(spark, sf_dir), ["user_key", "adgroup_id", "pid"]
    told = profile.united_counts(profile.distinct_sketches(rows, names, F.to_date("ts")), names)
    exact = profile.distinct_counts(rows, names)
    near = lambda c: (F.abs(F.col(f"n_{c}") - exact.select(f"n_{c}").scalar()) <= 0.05 * F.col(f"n_{c}")).alias(f"near_{c}")
    return told.select("n_rows", *(near(c) for c in names))


_MISSING = ["cate_id", "brand", "price", "cms_segid", "pvalue_level", "new_user_class_level", "clk"]


@_query(_WIDE + " " + " union all ".join(f"select '{c}' as column_name, round(avg(case when {c} is null then 1 else 0 end), 6) as missing_rate from wide" for c in _MISSING))
def missing_rates(spark, sf_dir):
    return profile.missing_rates(_wide(spark, sf_dir), _MISSING).select("column_name", _r("missing_rate"))


@_query(" select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_time from exposures")
def time_range(spark, sf_dir):
    out = profile.time_range(fixtures.exposures(spark, sf_dir))
    return out.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_time", "last_time")))


_SHAPE = ["event_id bigint", "user_key bigint", "ts timestamp_ntz", "adgroup_id bigint", "pid string", "clk int"]


@_query("+ shape as (select unnest([" + ", ".join(f"{{'position': {i}, 'column_name': '{c.split()[0]}', 'type': '{c.split()[1]}'}}" for i, c in enumerate(_SHAPE)) + """], recursive := true))
  select position, column_name, type, n_rows from shape cross join (select count(*) as n_rows from exposures)""")
def table_summary(spark, sf_dir):
    return profile.table_summary(fixtures.exposures(spark, sf_dir).select(*(c.split()[0] for c in _SHAPE)))


@_query(" select distinct user_key from exposures where user_key is not null")
def distinct_users(spark, sf_dir):
    return profile.distinct_users(fixtures.exposures(spark, sf_dir))


@_query(" select event_id, user_key, adgroup_id from exposures order by event_id limit 5")
def head_rows(spark, sf_dir):
    return profile.head(fixtures.exposures(spark, sf_dir), ["event_id"], 5).select("event_id", "user_key", "adgroup_id")


@_query(" select user_key, count(*) as n_behaviors from behaviors where user_key in (select user_key from exposures) group by user_key")
def behavior_counts_per_user(spark, sf_dir):
    return profile.behavior_counts_per_user(lookup.restrict_to_users(fixtures.behaviors(spark, sf_dir), fixtures.exposures(spark, sf_dir)))


_PRIOR = _LOG + """ , prior as (select e.event_id, count(s.r) as n_prior from exposures e left join seen s using (event_id)
  where e.user_key in (select user_key from behaviors) group by e.event_id)"""


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures of users without any behaviour are left out."""
    log = fixtures.behaviors(spark, sf_dir)
    return sequences.prior_count(lookup.restrict_to_users(fixtures.exposures(spark, sf_dir), log), log)


@_query(_PRIOR + " select " + ", ".join(f"round(quantile_cont(n_prior, {p}), 6) as q{round(100 * p)}" for p in profile.QUANTILES) + " from prior")
def length_quantiles(spark, sf_dir):
    out = profile.length_quantiles(_prior(spark, sf_dir), "n_prior")
    return out.select(*(_r(c) for c in out.columns))


@_query(_PRIOR + " select " + ", ".join(f"round(avg(case when n_prior > {k} then 1 else 0 end), 6) as over_{k}" for k in profile.TAILS) + " from prior")
def tail_shares(spark, sf_dir):
    out = profile.tail_shares(_prior(spark, sf_dir), "n_prior")
    return out.select(*(_r(c) for c in out.columns))


@_query("+ c as (select count(*) as n from behaviors group by user_key) select round(avg(n), 6) as mean, max(n) as max from c")
def mean_max_behaviors(spark, sf_dir):
    return profile.mean_max(profile.behavior_counts_per_user(fixtures.behaviors(spark, sf_dir)), "n_behaviors").select(_r("mean"), "max")


@_query("""+ h as (select * from behaviors where user_key in (select user_key from exposures)) select count(*) as hit_rows, count(distinct user_key) as hit_users,
  round(avg(case when brand is null then 1 else 0 end), 6) as brand_missing, round(count(distinct user_key) * 1.0 / (select count(distinct user_key) from exposures), 6) as user_share from h""")
def log_coverage(spark, sf_dir):
    return profile.log_coverage(fixtures.behaviors(spark, sf_dir), fixtures.exposures(spark, sf_dir)).select("hit_rows", "hit_users", _r("brand_missing"), _r("user_share"))


@_query(_LOG + """ , l as (select e.event_id, count(s.r) as seq_len from exposures e left join seen s on s.event_id = e.event_id and s.back <= 20 group by e.event_id)
  select count(*) as n, round(avg(seq_len), 6) as mean, round(stddev_samp(seq_len), 6) as std, min(seq_len) as min, max(seq_len) as max, round(quantile_cont(seq_len, 0.25), 6) as p25,
  round(quantile_cont(seq_len, 0.5), 6) as p50, round(quantile_cont(seq_len, 0.75), 6) as p75, round(quantile_cont(seq_len, 0.9), 6) as p90 from l""")
def seq_len_summary(spark, sf_dir):
    out = profile.seq_len_summary(_hist(spark, sf_dir).withColumn("seq_len", F.col("seq_len").cast("long")))
    return out.select("n", _r("mean"), _r("std"), "min", "max", *(_r(p) for p in ("p25", "p50", "p75", "p90")))


@_query("""+ a as (select strftime(ts, '%Y-%m-%d') as date, count(*) as n_exposures from exposures group by 1), b as (select strftime(ts, '%Y-%m-%d') as date, count(*) as n_behaviors from behaviors group by 1)
  select coalesce(a.date, b.date) as date, coalesce(n_exposures, 0) as n_exposures, coalesce(n_behaviors, 0) as n_behaviors, coalesce(n_exposures, 0) = coalesce(n_behaviors, 0) as agrees
  from a full outer join b on a.date = b.date""")
def day_count_audit(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    return profile.day_count_audit({"exposures": fixtures.exposures(spark, sf_dir), "behaviors": fixtures.behaviors(spark, sf_dir)}, {"exposures": day, "behaviors": day})


_SAMPLE = 100


@_query(f" select event_id, user_key from exposures order by md5('7:' || event_id::varchar), event_id limit {_SAMPLE}")
def sample_rows(spark, sf_dir):
    return profile.sample_rows(fixtures.exposures(spark, sf_dir), "event_id", _SAMPLE, seed=7).select("event_id", "user_key")


@_query(f" select event_id, user_key from exposures order by (event_id * 7919) % 10007, event_id limit {_SAMPLE}")
def sample_by_rank(spark, sf_dir):
    return profile.sample_by_rank(fixtures.exposures(spark, sf_dir), F.col("event_id") * 7919 % 10007, "event_id", _SAMPLE).select("event_id", "user_key")


@_query(_DATED + " select distinct date from dated order by date desc limit 2")
def last_dates(spark, sf_dir):
    return profile.last_dates(_dated(spark, sf_dir), 2)


# --- encoding


@_query(_WIDE + """ , v as (select distinct brand as b from wide where brand is not null), c as (select b, row_number() over (order by b) - 1 as i from v),
  v2 as (select distinct campaign_id as g from wide where campaign_id is not null), c2 as (select g, row_number() over (order by g) - 1 as j from v2)
  select event_id, coalesce(i, -1) as brand, coalesce(j, -1) as campaign_id from wide left join c on brand = b left join c2 on campaign_id = g""")
def dense_codes(spark, sf_dir):
    return encode.dense_codes(_wide(spark, sf_dir), ["brand", "campaign_id"]).select("event_id", "brand", "campaign_id")


@_query(_WIDE + " select event_id, coalesce(final_gender_code::varchar, 'nan') || '_' || coalesce(cate_id::varchar, 'nan') as gender_cate_cross from wide")
def gender_cate_cross(spark, sf_dir):
    return encode.add_cross(_wide(spark, sf_dir), "final_gender_code", "cate_id", "gender_cate_cross").select("event_id", "gender_cate_cross")


_SPLIT = _DATED + """ , days as (select date, row_number() over (order by date desc) as back from (select distinct date from dated)),
  parts as (select d.*, case when back = 1 then 'test' when back = 2 then 'valid' else 'train' end as split from dated d join days using (date))"""


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_three_way(_dated(spark, sf_dir))[0]


@_query(_SPLIT + """ , v as (select distinct brand::varchar as b from parts where split = 'train' and brand is not null), c as (select b, row_number() over (order by b) + 1 as i from v)
  select event_id, coalesce(i, 1) as brand_id from parts left join c on brand::varchar = b""")
def vocab_encode(spark, sf_dir):
    vocabulary = encode.fit_vocab(_train(spark, sf_dir), "brand")
    return lookup.vocab_lookup(_dated(spark, sf_dir), vocabulary, "brand", "brand_id").select("event_id", "brand_id")


_SHARED = _LOG + """ , recent as (select * from seen where back <= 20),
  vals as (select distinct v from (select cate_id::varchar as v from exposures join ads using (adgroup_id) union all select cate::varchar from recent) where v is not null),
  voc as (select v, row_number() over (order by v) + 1 as id from vals)"""


def _with_history(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    log = fixtures.behaviors(spark, sf_dir)
    out = sequences.asof_history(lookup.attach_ads(fixtures.exposures(spark, sf_dir), fixtures.ads(spark, sf_dir)), log, ["item", "cate", "brand"], n)
    return out.withColumns({"cates": field_of(F.col("hist"), "cate"), "items": field_of(F.col("hist"), "item"), "brands": field_of(F.col("hist"), "brand")})


@_query(_SHARED + " select v as value, id from voc")
def shared_vocab(spark, sf_dir):
    return encode.fit_shared_vocab(_with_history(spark, sf_dir), "cate_id", "cates")


@_query(_SHARED + " select v as value, count(*) as n from (select cate_id::varchar as v from exposures join ads using (adgroup_id) union all select cate::varchar from recent) group by v")
def union_values(spark, sf_dir):
    return encode.union_values(_with_history(spark, sf_dir), "cate_id", "cates").where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


@_query(" select distinct brand as value from behaviors where brand is not null")
def distinct_values(spark, sf_dir):
    return encode.distinct_values(fixtures.behaviors(spark, sf_dir), "brand")


@_query(_SHARED + """ select e.event_id, coalesce(string_agg(id::varchar, ',' order by r), '') as ids from exposures e left join (select event_id, r, id from recent join voc on cate::varchar = v) s
  using (event_id) group by e.event_id""")
def encode_sequence(spark, sf_dir):
    """The vocabulary is fitted on the behaviours that histories hold; the log is encoded once, so that lists hold ids."""
    exposures, log = lookup.attach_ads(fixtures.exposures(spark, sf_dir), fixtures.ads(spark, sf_dir)), fixtures.behaviors(spark, sf_dir)
    vocabulary = encode.fit_log_vocab(exposures, "cate_id", sequences.in_reach(exposures, log, 20), "cate")
    coded = encode.encode_log(log, vocabulary, "cate", "cate_code")
    return sequences.asof_history(exposures, coded, ["cate_code"], 20).withColumn("ids", field_of(F.col("hist"), "cate_code")).select("event_id", _joined("ids"))


@_query(_SHARED + """ select e.event_id, coalesce(string_agg(id::varchar, ',' order by r), '') as ids from exposures e left join (select event_id, r, id from recent join voc on cate::varchar = v) s
  using (event_id) group by e.event_id""")
def encode_lists(spark, sf_dir):
    """The same for lists that are given, without a log."""
    rows = _with_history(spark, sf_dir)
    out = encode.encode_sequence(rows, encode.fit_shared_vocab(rows, "cate_id", "cates"), "cates", "event_id", "ids")
    return out.select("event_id", _joined("ids"))


@_query(_LOG + """ , l as (select e.event_id, coalesce(string_agg(s.cate::varchar, ',' order by s.r), '') as t, count(s.r) as n from exposures e
  left join seen s on s.event_id = e.event_id and s.back <= 5 group by e.event_id)
  select event_id, case when n = 0 then repeat('0,', 7) || '0' else t || repeat(',0', (8 - n)::int) end as padded, repeat('true,', n::int) || rtrim(repeat('false,', (8 - n)::int), ',') as mask from l""")
def pad_sequences(spark, sf_dir):
    out = encode.pad_sequences(_with_history(spark, sf_dir, 5).withColumn("padded", F.col("cates").cast("array<bigint>")), "padded", 8)
    return out.withColumn("mask", mask(F.col("seq_len"), 8)).select("event_id", _joined("padded"), _joined("mask"))


@_query(_SPLIT + """ , k as (select split, user_key * 100000 + adgroup_id as pair from parts) select distinct pair as value from k where split = 'test' and pair not in (select pair from k where split = 'train')""")
def unseen_values(spark, sf_dir):
    train, _, test = split.split_three_way(_dated(spark, sf_dir).withColumn("pair", F.col("user_key") * 100000 + F.col("adgroup_id")))
    return encode.unseen_values(test, train, "pair")


_LAST = _DATED + " , parts as (select *, case when date = (select max(date) from dated) then 'valid' else 'train' end as split from dated)"


@_query(_LAST + """ , m as (select avg(price) as a, case when stddev_samp(price) = 0 then 1 else stddev_samp(price) end as s from parts where split = 'train')
  select event_id, round((price - a) / s, 6) as price from parts cross join m where split = 'valid'""")
def standardize(spark, sf_dir):
    train, valid = split.split_last_date(_dated(spark, sf_dir))
    return encode.standardize(valid, encode.fit_moments(train, ["price"]), ["price"]).select("event_id", _r("price"))


@_query(_LAST + " select round(avg(price), 6) as price_mean, round(stddev_samp(price), 6) as price_std, round(avg(age_level), 6) as age_level_mean, round(stddev_samp(age_level), 6) as age_level_std from parts where split = 'train'")
def fit_moments(spark, sf_dir):
    out = encode.fit_moments(split.split_last_date(_dated(spark, sf_dir))[0], ["price", "age_level"])
    return out.select(*(_r(c) for c in out.columns))


@_query(_WIDE + " select max(brand) + 1 as brand, max(cate_id) + 1 as cate_id, max(cms_segid) + 1 as cms_segid from wide")
def vocab_sizes(spark, sf_dir):
    return encode.vocab_sizes(_wide(spark, sf_dir), ["brand", "cate_id", "cms_segid"])


@_query(_LAST + """ , t as (select brand as b, count(*) as n from parts where split = 'train' and brand is not null group by brand),
  k as (select b, row_number() over (order by n desc, b) as i from t) select event_id, case when i <= 5 then i else 0 end as brand_top from parts left join k on brand = b""")
def top_k_or_other(spark, sf_dir):
    rows = _dated(spark, sf_dir)
    return encode.top_k_or_other(rows, split.split_last_date(rows)[0], "brand", 5, "brand_top").select("event_id", "brand_top")


# --- splits


@_query(_LAST + " select event_id, split from parts")
def split_last_date(spark, sf_dir):
    return split.named_split(_dated(spark, sf_dir), 1).select("event_id", "split")


@_query(_SPLIT + " select event_id, split from parts")
def split_three_way(spark, sf_dir):
    return split.named_split(_dated(spark, sf_dir), 2).select("event_id", "split")


@_query(_SPLIT + " select split, round(avg(clk), 6) as click_rate, count(*) as n from parts group by split")
def mean_click_rate(spark, sf_dir):
    return profile.mean_click_rate(split.named_split(_dated(spark, sf_dir), 2)).select("split", _r("click_rate"), "n")


# --- interest features


_POOL = _LOG + """ , recent as (select * from seen where back <= 5),
  scored as (select s.event_id, s.r, i.embedding as v, list_dot_product(t.embedding::double[], i.embedding::double[]) / sqrt(len(t.embedding)) as sc
    from recent s join embeddings t on t.vec_id = s.adgroup_id join embeddings i on i.vec_id = s.item),
  soft as (select *, exp(sc - max(sc) over (partition by event_id)) as w from scored), z as (select event_id, sum(w) as z from soft group by event_id),
  flat as (select s.event_id, unnest(generate_series(1, len(v))) as d, unnest(v)::double * w / z as x from soft s join z using (event_id)),
  pooled as (select event_id, d, sum(x) as x from flat group by event_id, d),
  told as (select event_id, round(sum(x), 6) as total, round(sum(x * d), 6) as weighted, round(sum(x * x), 6) as square from pooled group by event_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _digest(vector: str) -> list[Column]:
    """Three sums that tell a vector apart."""
    add = lambda t, x: t + x
    v = F.col(vector)
    return [
        _r(F.aggregate(v, F.lit(0.0), add), "total"),
        _r(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), add), "weighted"),
        _r(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add), "square"),
    ]


@_query(_POOL + " select event_id, total, weighted, square from exposures left join told using (event_id)")
def attention_pool(spark, sf_dir):
    out = attention.attention_pool(_with_history(spark, sf_dir, 5), _vectors(spark, sf_dir), "event_id", "adgroup_id", "items")
    return out.select("event_id", *_digest("interest"))


#: Weights of a scorer over vectors of 64 numbers, by a rule.
_UNITS = (4, 3)
_SCORER = {
    "s1": [[((7 * i + 13 * j) % 11 - 5) / 10 for j in range(_UNITS[0])] for i in range(256)], "s1b": [0.1 * j for j in range(_UNITS[0])],
    "s2": [[((5 * i + 3 * j) % 7 - 3) / 2 for j in range(_UNITS[1])] for i in range(_UNITS[0])], "s2b": [-0.2 * j for j in range(_UNITS[1])], "s3": [8.0, -5.0, 11.0], "s3b": [0.25],
}


def _layer_sql(x: str, w: str) -> str:
    units = zip(zip(*_SCORER[w]), _SCORER[f"{w}b"])
    return "[" + ", ".join(f"1 / (1 + exp(-(list_dot_product({x}, {[float(v) for v in unit]}::double[]) + {c})))" for unit, c in units) + "]"


_LEARNED = _POOL.replace("scored as (", f"""pairs as (select s.event_id, s.r, i.embedding as v, t.embedding::double[] as t, i.embedding::double[] as h
    from recent s join embeddings t on t.vec_id = s.adgroup_id join embeddings i on i.vec_id = s.item),
  four as (select *, list_concat(list_concat(t, h), list_concat([t[k] - h[k] for k in generate_series(1, len(t))], [t[k] * h[k] for k in generate_series(1, len(t))])) as x from pairs),
  first_layer as (select *, {_layer_sql("x", "s1")} as y from four), second_layer as (select *, {_layer_sql("y", "s2")} as z from first_layer),
  scored as (select event_id, r, v, (list_dot_product(z, {_SCORER["s3"]}::double[]) + {_SCORER["s3b"][0]}) / sqrt(len(t)) as sc from second_layer), unused as (""")


@_query(_LEARNED + " select event_id, total, weighted, square from exposures left join told using (event_id)")
def learned_attention(spark, sf_dir):
    """The same pooling with scores by two hidden layers of given weights."""
    out = attention.attention_pool(_with_history(spark, sf_dir, 5), _vectors(spark, sf_dir), "event_id", "adgroup_id", "items", attention.learned_score(_SCORER))
    return out.select("event_id", *_digest("interest"))


@_query(_POOL + """ , cnt as (select e.event_id, count(s.r) as n, count(case when s.cate = a.cate_id then 1 end) as hits, min(case when s.cate = a.cate_id then s.back end) as ago
    from exposures e left join ads a using (adgroup_id) left join recent s on s.event_id = e.event_id group by e.event_id)
  select c.event_id, coalesce(total, 0) as total, coalesce(weighted, 0) as weighted, coalesce(square, 0) as square, hits as cate_hits,
    round(case when n > 0 then hits * 1.0 / n else 0 end, 6) as cate_share, ago as cate_ago from cnt c left join told using (event_id)""")
def interest_features(spark, sf_dir):
    rows = _with_history(spark, sf_dir, 5)
    out = attention.interest_features(rows, _vectors(spark, sf_dir), "event_id", "adgroup_id", "items", {"cate": ("cate_id", "cates")})
    return out.select("event_id", *_digest("interest"), "cate_hits", _r("cate_share"), "cate_ago")


# --- metrics


_SCORED = """+ scored as (select event_id, clk, (event_id * 37 % 1000 + 0.5) / 1000.0 as score from exposures)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.exposures(spark, sf_dir).withColumn("score", (F.col("event_id") * 37 % 1000 + 0.5) / 1000.0)


@_query(_SCORED + """ , s as (select score, sum(clk) as p, count(*) - sum(clk) as n from scored group by score), r as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s)
  select round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) as auc from r""")
def auc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir)).select(_r("auc"))


@_query(_SCORED + " select round(avg(-(clk * ln(score) + (1 - clk) * ln(1 - score))), 6) as logloss from scored")
def logloss(spark, sf_dir):
    return metrics.logloss(_scored(spark, sf_dir)).select(_r("logloss"))


# --- samples and models


_PAST = "rows between unbounded preceding and 1 preceding"
_AD, _USER, _PAIR = (f"(partition by {k} order by ts, event_id {_PAST})" for k in ("adgroup_id", "user_key", "user_key, cate_id"))
_COUNTED = _WIDE + f""" , raw as (select *, count(*) over {_AD} as ai, coalesce(sum(clk) over {_AD}, 0) as ac, count(*) over {_USER} as ui, coalesce(sum(clk) over {_USER}, 0) as uc,
    case when cate_id is null then null else count(*) over {_PAIR} end as ci, case when cate_id is null then 0 else coalesce(sum(clk) over {_PAIR}, 0) end as cc from wide),
  counted as (select * exclude (ai, ac, ui, uc, ci, cc), extract(hour from ts + interval 8 hour) as hour, isodow(ts + interval 8 hour) - 1 as weekday, strftime(ts + interval 8 hour, '%Y-%m-%d') as date,
    cast(ai as bigint) as ad_hist_imp, cast(ac as bigint) as ad_hist_clk, round((ac + 0.5) / (ai + 10.0), 6) as ad_hist_ctr, cast(ui as bigint) as user_hist_imp, cast(uc as bigint) as user_hist_clk,
    round((uc + 0.25) / (ui + 5.0), 6) as user_hist_ctr, cast(ci as bigint) as user_cate_hist_imp, cast(cc as bigint) as user_cate_hist_clk, round((cc + 0.25) / (ci + 5.0), 6) as user_cate_hist_ctr,
    coalesce(final_gender_code::varchar, 'nan') || '_' || coalesce(cate_id::varchar, 'nan') as gender_cate_cross from raw)"""


def _plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates and lists as texts."""
    kinds = dict(df.dtypes)
    told = {c: _r(c) for c, k in kinds.items() if k == "double"} | {c: F.col(c).cast("string").alias(c) for c, k in kinds.items() if k == "date"} | {c: _joined(c) for c, k in kinds.items() if k.startswith("array")}
    return df.select(*(told.get(c, F.col(c)) for c in df.columns))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fixtures.exposures(spark, sf_dir), fixtures.ads(spark, sf_dir), fixtures.profiles(spark, sf_dir)


def _names(columns: list[str], told: dict[str, str]) -> str:
    return ", ".join(f"{told[c]} as {c}" if c in told else c for c in columns)


def _code_sql(c: str) -> str:
    return f"case when {c} is null then -1 else dense_rank() over (order by {c} nulls last) - 1 end"


_KNOWN = {c: f"coalesce({c}, -1) + 1" for c in ("brand", "pvalue_level", "new_user_class_level")} | {"price": "round(price, 6)"}


@_query(_WIDE + " select " + _names(
    ["event_id", "user_key", "adgroup_id", "pid", "clk", "cate_id", "brand", "price", "pvalue_level", "new_user_class_level", "age_level"],
    {c: f"coalesce({c}, -1)" for c in ("brand", "pvalue_level", "new_user_class_level")} | {"price": "round(price, 6)"},
) + " from wide")
def lr_sample(spark, sf_dir):
    names = ["event_id", "user_key", "adgroup_id", "pid", "clk", "cate_id", "brand", "price", "pvalue_level", "new_user_class_level", "age_level"]
    return _plain(samples.lr_sample(*_parts(spark, sf_dir)).select(*names))


@_query(_COUNTED + " select " + _names([*samples._TABULAR, *samples._TIME, *(f"{p}_hist_{c}" for p in ("ad", "user", "user_cate") for c in ("imp", "clk", "ctr"))], _KNOWN | {"pid": _code_sql("pid")}) + " from counted")
def tabular_sample(spark, sf_dir):
    return _plain(samples.tabular_sample(*_parts(spark, sf_dir)))


@_query(_COUNTED + " , filled as (select * replace (coalesce(brand, -1) as brand) from counted) select " + _names(
    [*samples._NETWORK, *samples._TIME, *samples._NETWORK_COUNTERS, "gender_cate_cross"], {c: _code_sql(c) for c in samples._CODED} | {"price": "round(price, 6)"},
) + " from filled")
def network_sample(spark, sf_dir):
    return _plain(samples.network_sample(*_parts(spark, sf_dir)))


@_query(_COUNTED + """ , logs as (select *, row_number() over (partition by user_key order by ts, event_id) as r from behaviors where btag = 'pv'),
  seen as (select e.event_id, l.cate, l.brand, l.r, row_number() over (partition by e.event_id order by l.r desc) as back from exposures e join logs l on l.user_key = e.user_key and l.ts < e.ts),
  lists as (select event_id, string_agg(cate::varchar, ',' order by r) as cates, string_agg(coalesce(brand::varchar, ''), ',' order by r) as brands, count(*) as n from seen where back <= 220 group by event_id)
  select event_id, """ + _names([*samples._NETWORK, *samples._TIME, *samples._NETWORK_COUNTERS, "gender_cate_cross"], {"brand": "coalesce(brand, -1)", "price": "round(price, 6)"})
  + ", coalesce(cates, '') as hist_cate_seq, coalesce(brands, '') as hist_brand_seq, coalesce(n, 0) as seq_len from counted left join lists using (event_id)")
def sequence_sample(spark, sf_dir):
    out = samples.sequence_sample(*_parts(spark, sf_dir), fixtures.behaviors(spark, sf_dir))
    return _plain(out.drop("ts"))


def _seconds() -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("time_stamp")


@_query(" select user_key as user, floor(epoch(ts))::bigint as time_stamp, adgroup_id, pid, 1 - clk as nonclk, clk from exposures")
def read_exposures(spark, sf_dir):
    """Exposures written as CSV and read through their reader."""
    told = fixtures.exposures(spark, sf_dir)
    folder = sources.own_folder(spark)
    sources.write_sample(told.select(F.col("user_key").alias("user"), _seconds(), "adgroup_id", "pid", (1 - F.col("clk")).alias("nonclk"), "clk"), folder, "csv")
    return sources.read_exposures(spark, folder)


@_query(" select adgroup_id, cate_id, brand, round(price, 6) as price from ads")
def read_ads(spark, sf_dir):
    """Ads written as CSV, headers with blanks and missing numbers as NaN, and read through their reader."""
    told, folder = fixtures.ads(spark, sf_dir), sources.own_folder(spark)
    named = told.select("adgroup_id", "cate_id", F.hash("campaign_id").cast("long").alias(" campaign_id"), F.lit(1).alias("customer "), "brand", F.coalesce("price", F.lit(float("nan"))).alias("price"))
    sources.write_sample(named, folder, "csv")
    return sources.read_ads(spark, folder).select("adgroup_id", "cate_id", "brand", _r("price"))


@_query(" select userid, cms_segid, pvalue_level, new_user_class_level from profiles")
def read_profiles(spark, sf_dir):
    folder = sources.own_folder(spark)
    sources.write_sample(fixtures.profiles(spark, sf_dir), folder, "csv")
    return sources.read_profiles(spark, folder).select("userid", "cms_segid", "pvalue_level", "new_user_class_level")


@_query(" select user_key as user, floor(epoch(ts))::bigint as time_stamp, cate, brand from behaviors where btag = 'pv' and user_key in (select user_key from exposures)")
def materialize_behaviors(spark, sf_dir):
    """The prepared log of exposed users, written once by the content of both inputs."""
    log = fixtures.behaviors(spark, sf_dir).select(F.col("user_key").alias("user"), _seconds(), "btag", "cate", "brand")
    users = fixtures.exposures(spark, sf_dir).select(F.col("user_key").alias("user"))
    return sources.materialize_behaviors(log, users, f"{shared_folder(spark)}/prepared-log").select("user", "time_stamp", "cate", "brand")


@_query(_LAST + """ , cats as (select pid as p, row_number() over (order by pid) - 1 as i, count(*) over () as k from (select distinct pid from parts where split = 'train'))
  select event_id, (select string_agg(case when j = i then '1' else '0' end, ',' order by j) from generate_series(0, k - 1) s(j)) as pid_hot from parts join cats on pid = p where split = 'valid'""")
def one_hot(spark, sf_dir):
    train, valid = split.split_last_date(_dated(spark, sf_dir))
    hot = vector_to_array("pid_hot").cast("array<int>")
    return encode.one_hot(train, ["pid"]).transform(valid).withColumn("pid_hot", hot).select("event_id", _joined("pid_hot"))


@_query(_WIDE + " select event_id, round(coalesce(price, 0), 6) as first, clk::double as last, 3 as width from wide")
def assemble(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumns({"price": F.coalesce("price", F.lit(0.0)), "_one": F.lit(1.0)})
    told = encode.assemble(rows, ["price", "_one", "clk"]).withColumn("v", vector_to_array("features"))
    return told.select("event_id", _r(F.get("v", F.lit(0)), "first"), _r(F.get("v", F.lit(2)), "last"), F.size("v").alias("width"))


#: The inputs of each kind of model.
_LR = (["hour", "weekday", "pid", "cate_id", "cms_group_id", "final_gender_code", "occupation"], ["age_level", "shopping_level"])
_COUNTERS = ["ad_hist_imp", "ad_hist_clk", "user_hist_imp", "user_hist_clk", "user_hist_ctr", "user_cate_hist_imp", "user_cate_hist_clk", "user_cate_hist_ctr"]
_TREES = (["hour", "weekday", "pid", "cate_id", "cms_group_id", "final_gender_code", "occupation", "brand"], ["price", "age_level", "shopping_level", *_COUNTERS])
_NET = ([*_TREES[0], "cms_segid"], _TREES[1])
_LINEAR = (["gender_cate_cross", "pid", "hour", "weekday", "cate_id", "brand"], ["price", "ad_hist_imp", "ad_hist_clk", "user_hist_ctr", "user_cate_hist_ctr"])


def _model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows with event_id, time parts, counters and the cross. They are kept in memory or on disk, since a
    fit reads them many times. The joined rows are written first, since each counter looks for its heavy keys in them."""
    wide = sources.written(samples.wide(*_parts(spark, sf_dir)))
    out = clean.add_time_parts(samples.counters(wide), "ts", LOCAL_ZONE)
    out = encode.add_cross(clean.fill_unknown(out, ["brand"]), "final_gender_code", "cate_id", "gender_cate_cross")
    return split.split_last_date(out.select("event_id", "clk", "date", *dict.fromkeys(c for group in (_LR, _NET, _LINEAR) for part in group for c in part)).persist())


def _fit_and_score(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    train, valid = _model_rows(spark, sf_dir)
    return models.score(fit(train), valid).select("event_id", "clk", _r("score"))


@_query()
def score_lr(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, lambda t: models.fit_lr(t, *_LR))


@_query()
def score_gbt(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, lambda t: models.fit_gbt(t, *_TREES))


@_query()
def score_gbt_early(spark, sf_dir):
    """Boosting that stops once a tenth of the training rows, held out by hash, no longer gains."""
    def fit(train):
        held = train.withColumn("held", F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
        return models.fit_gbt(held, *_TREES, leaves=31, subsample=0.8, validation="held")

    return _fit_and_score(spark, sf_dir, fit)


@_query()
def score_cross(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, lambda t: models.fit_cross(t, *_NET))


@_query()
def score_wide(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, lambda t: models.fit_wide(t, *_LINEAR, hash_size=1 << 12))


@_query()
def score_deep(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, lambda t: models.fit_deep(t, *_NET))


@_query()
def item_embeddings(spark, sf_dir):
    told = sequences.collect_user_log(fixtures.behaviors(spark, sf_dir), ["item"]).withColumn("items", field_of(F.col("log"), "item"))
    return attention.item_embeddings(told, "items").select("id", F.size("vector").alias("size"), F.array_join(F.transform("vector", lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


@_query()
def leaderboard(spark, sf_dir):
    """A grid over two kinds of model, whose inputs are prepared once each."""
    train, valid = _model_rows(spark, sf_dir)
    linear, trees = models.ready(train, *_LR), models.ready(train, *_TREES, trees=True)
    fits = {"lr": lambda: models.lr(linear), "lr_strong_penalty": lambda: models.lr(linear, c=0.01), "gbt_3_leaves": lambda: models.gbt(trees), "gbt_8_leaves": lambda: models.gbt(trees, leaves=8)}
    return models.leaderboard(fits, valid).drop("seconds")


_INTEREST = interest.Inputs(
    ["user_key", "adgroup_id", "pid", "cms_segid", "cms_group_id", "final_gender_code", "occupation", "hour", "weekday"], {"cate_id": "cates", "brand": "brands"}, ["price", "age_level", "shopping_level"],
)


#: Weights of two cross layers of rank 2 over four numbers, by a rule.
_CROSS = [{"v": [[((3 * i + 5 * k + layer) % 7 - 3) / 4 for k in range(2)] for i in range(4)], "u": [[((2 * k + 3 * i + layer) % 5 - 2) / 4 for i in range(4)] for k in range(2)], "b": [0.1 * i - 0.2 for i in range(4)]} for layer in range(2)]


def _cross_sql(x: str, w: dict) -> str:
    low = [f"list_dot_product({x}, {[row[k] for row in w['v']]}::double[])" for k in range(2)]
    return "[" + ", ".join(f"x0[{i + 1}] * ({low[0]} * ({w['u'][0][i]}) + {low[1]} * ({w['u'][1][i]}) + ({w['b'][i]})) + {x}[{i + 1}]" for i in range(4)) + "]"


@_query(_WIDE + f""" , start as (select event_id, [coalesce(price, 0) / 1000.0, coalesce(age_level, 0) / 10.0, coalesce(shopping_level, 0) / 10.0, clk::double]::double[] as x0 from wide),
  one as (select *, {_cross_sql("x0", _CROSS[0])} as x1 from start), two as (select *, {_cross_sql("x1", _CROSS[1])} as x2 from one)
  select event_id, round(x2[1], 6) as a, round(x2[2], 6) as b, round(x2[3], 6) as c, round(x2[4], 6) as d from two""")
def cross_layers(spark, sf_dir):
    """Two low-rank cross layers of given weights over four numbers of each exposure."""
    rows = _wide(spark, sf_dir)
    x0 = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scale for c, scale in (("price", 1000.0), ("age_level", 10.0), ("shopping_level", 10.0))] + [F.col("clk").cast("double")]
    rows = rows.select("event_id", *(c.alias(f"x{i}") for i, c in enumerate(x0)))
    first = [F.col(f"x{i}") for i in range(4)]
    rows = rows.select("event_id", *first, *(c.alias(f"y{i}") for i, c in enumerate(interest.cross_layer(first, first, **_CROSS[0]))))
    out = interest.cross_layer(first, [F.col(f"y{i}") for i in range(4)], **_CROSS[1])
    return rows.select("event_id", *(_r(c, n) for c, n in zip(out, "abcd")))


def _fit_network(spark: SparkSession, sf_dir: str, inputs: interest.Inputs, shape: interest.Shape) -> DataFrame:
    train, valid = _model_rows(spark, sf_dir)
    return interest.fit_interest(train, inputs, shape, passes=3, shards=4).score(valid).select("event_id", "clk", _r("score"))


@_query()
def score_cross_network(spark, sf_dir):
    """Two low-rank cross layers before two hidden ones."""
    return _fit_network(spark, sf_dir, interest.Inputs(*(_NET[0], {}, _NET[1])), interest.Shape(cross=2, rank=16))


@_query()
def score_wide_deep(spark, sf_dir):
    """A wide part over crosses and a deep part, fitted together."""
    return _fit_network(spark, sf_dir, interest.Inputs(_NET[0], {}, _NET[1], wide=_LINEAR[0], wide_dense=_LINEAR[1]), interest.Shape())


@_query()
def score_interest(spark, sf_dir):
    """Learned attention over each user's last behaviours, with user, ad and context; the scorer's width is chosen on the newest day
    but one, and the newest day is scored by the chosen model alone. The joined rows are written first, since the history looks for
    heavy users in them and then reads them again."""
    held = ["event_id", "clk", "date", *_INTEREST.scalars, *_INTEREST.targets, *_INTEREST.dense]
    wide = sources.written(clean.add_time_parts(samples.wide(*_parts(spark, sf_dir)), "ts", LOCAL_ZONE).select("ts", *held))
    seen = sequences.asof_history(wide, fixtures.behaviors(spark, sf_dir), ["cate", "brand"], 50)
    rows = seen.select(*held, *(field_of(F.col("hist"), f).alias(h) for f, h in (("cate", "cates"), ("brand", "brands"))))
    train, valid, test = split.split_three_way(sources.written(rows))
    shapes = {"narrow": interest.Shape(scorer=(16, 8)), "wide": interest.Shape(scorer=(32, 16))}
    given = interest.ready(train, _INTEREST, shards=4)
    fits = {name: lambda shape=shape: interest.fit(given, shape, passes=3) for name, shape in shapes.items()}
    chosen = models.choose(fits, valid, test)
    return chosen.model.score(test).select("event_id", "clk", _r("score"), F.lit(chosen.name).alias("model"))
