"""Declared schemas of the four input tables; nothing is inferred from files."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


EXPOSURES = StructType([
    *_longs("user", "time_stamp", "adgroup_id"), StructField("pid", StringType()), StructField("nonclk", IntegerType()), StructField("clk", IntegerType()),
])
ADS = StructType([*_longs("adgroup_id", "cate_id", "campaign_id", "customer", "brand"), StructField("price", DoubleType())])
PROFILES = StructType(_longs(
    "userid", "cms_segid", "cms_group_id", "final_gender_code", "age_level", "pvalue_level", "shopping_level", "occupation", "new_user_class_level",
))
BEHAVIORS = StructType([*_longs("user", "time_stamp"), StructField("btag", StringType()), *_longs("cate", "brand")])
