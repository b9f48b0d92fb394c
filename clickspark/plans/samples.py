"""The four training-sample builders, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import LOCAL_ZONE, field_of, local_time
from ..operators import clean, encode, history, lookup, sequences

_NETWORK = ["clk", "pid", "user_key", "adgroup_id", "cate_id", "cms_group_id", "cms_segid", "final_gender_code", "occupation", "age_level", "shopping_level", "brand", "price"]
_TABULAR = [*_NETWORK, "pvalue_level", "new_user_class_level"]
_TIME = ["hour", "weekday", "date"]
_CODED = ["pid", "cate_id", "brand", "cms_group_id", "cms_segid", "final_gender_code", "occupation", "age_level", "shopping_level", "gender_cate_cross"]


def wide(exposures: DataFrame, ads: DataFrame, profiles: DataFrame, user: str = "user_key") -> DataFrame:
    """Exposures with their ads' and users' columns."""
    return lookup.attach_profiles(lookup.attach_ads(exposures, ads), profiles, user)


def counters(df: DataFrame, time: str = "ts", tie: str = "event_id", user: str = "user_key") -> DataFrame:
    """Counters of the ad, the user, and the user and category. Any of them may be very frequent; such keys are found by count."""
    df = history.history(df, ["adgroup_id"], "ad", [time, tie], a=0.5, b=10.0)
    df = history.history(df, [user], "user", [time, tie])
    return history.history(df, [user, "cate_id"], "user_cate", [time, tie])


def lr_sample(exposures: DataFrame, ads: DataFrame, profiles: DataFrame) -> DataFrame:
    """All joined columns, missing values as -1."""
    out = wide(exposures, ads, profiles)
    return clean.fill_unknown(out, ["brand", "pvalue_level", "new_user_class_level"])


def tabular_sample(exposures: DataFrame, ads: DataFrame, profiles: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Columns, time parts and nine counters for trees; unknown is class 0."""
    out = clean.add_time_parts(counters(wide(exposures, ads, profiles)), "ts", zone)
    unknown = ["brand", "pvalue_level", "new_user_class_level"]
    out = clean.shift_unknown(clean.fill_unknown(out, unknown), unknown)
    out = encode.dense_codes(out, ["pid"])
    names = [f"{p}_hist_{c}" for p in ("ad", "user", "user_cate") for c in ("imp", "clk", "ctr")]
    return out.select(*_TABULAR, *_TIME, *names)


def _network(wide_rows: DataFrame, zone: str) -> DataFrame:
    out = clean.fill_unknown(clean.add_time_parts(wide_rows, "ts", zone), ["brand"])
    return encode.add_cross(out, "final_gender_code", "cate_id", "gender_cate_cross")


_NETWORK_COUNTERS = ["ad_hist_imp", "ad_hist_clk", *(f"{p}_hist_{c}" for p in ("user", "user_cate") for c in ("imp", "clk", "ctr"))]


def network_sample(exposures: DataFrame, ads: DataFrame, profiles: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Densely coded columns, time parts and eight counters."""
    rows = wide(exposures, ads, profiles)
    out = encode.dense_codes(_network(counters(rows), zone), _CODED, _network(rows, zone))
    return out.select(*_NETWORK, *_TIME, *_NETWORK_COUNTERS, "gender_cate_cross")


def sequence_sample(exposures: DataFrame, ads: DataFrame, profiles: DataFrame, log: DataFrame, n: int = 220, btag: str | None = "pv", zone: str = LOCAL_ZONE) -> DataFrame:
    """Uncoded columns with the categories and brands of the last n behaviours strictly before the exposure."""
    kept = log if btag is None else clean.filter_btag(log, btag)
    kept = lookup.restrict_to_users(kept, exposures)
    out = sequences.asof_history(_network(counters(wide(exposures, ads, profiles)), zone), kept, ["cate", "brand"], n)
    told = {"hist_cate_seq": field_of(F.col("hist"), "cate").cast("array<bigint>"), "hist_brand_seq": field_of(F.col("hist"), "brand")}
    return out.withColumns(told).select("event_id", "ts", *_NETWORK, *_TIME, *_NETWORK_COUNTERS, "gender_cate_cross", "hist_cate_seq", "hist_brand_seq", "seq_len")
