"""Explicit schemas of the boundary tables; nothing is inferred."""

from pyspark.sql import types as T

FARMS = T.StructType([
    T.StructField("farm_id", T.LongType(), False),
    T.StructField("area_ha", T.DoubleType()),
    T.StructField("n_cells", T.LongType()),
    T.StructField("commodity", T.StringType()),
    T.StructField("geometry", T.StringType()),
])

FARM_RUNS = T.StructType([
    T.StructField("farm_id", T.LongType(), False),
    T.StructField("row", T.LongType(), False),
    T.StructField("col_lo", T.LongType(), False),
    T.StructField("col_hi", T.LongType(), False),
])

CELLS = T.StructType([
    T.StructField("row", T.LongType(), False),
    T.StructField("col", T.LongType(), False),
    T.StructField("crop_prob", T.DoubleType()),
    T.StructField("forest2020", T.IntegerType()),
    T.StructField("lossyear", T.IntegerType()),
    T.StructField("area_m2", T.DoubleType()),
])

ASSESSMENTS = T.StructType([
    T.StructField("farm_id", T.LongType(), False),
    T.StructField("defo_m2", T.DoubleType()),
    T.StructField("total_m2", T.DoubleType()),
    T.StructField("defo_pct", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_class", T.StringType()),
    T.StructField("assessed_at", T.TimestampType()),
])

FEATURES = T.StructType([
    T.StructField("farm_id", T.LongType(), False),
    T.StructField("dist_to_defo_m", T.DoubleType()),
    T.StructField("dist_to_defo_m_masked", T.DoubleType()),
    T.StructField("nb_defo_pct_200", T.DoubleType()),
    T.StructField("nb_defo_pct_500", T.DoubleType()),
    T.StructField("nb_defo_pct_1000", T.DoubleType()),
])
