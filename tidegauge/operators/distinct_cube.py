"""Counts of distinct values for all combinations of some columns, from bitmaps.

Each distinct value gets a number from 1 on without gaps. The rows of each finest group set bits in bitmaps of 32,768 numbers; the
bitmaps of coarser groups are those of finer ones put together. Values are shuffled once, for the finest groups, instead of
once for each combination of the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.snapshot import with_position


def distinct_cube(df: DataFrame, dims: list[str], value: str, name: str = "n_distinct") -> DataFrame:
    """dims, grouping_id, ``name``: the number of distinct values that aren't null, for the cube of ``dims``.

    A column that a row doesn't group by is null there; grouping_id has its bit set (the last column's is 1), which tells that null
    from a group of nulls.
    """
    rows = df.select(*dims, F.col(value).alias("__v")).distinct()
    codes = with_position(rows.where("__v is not null").select(F.col("__v").alias("__w")).distinct(), [F.col("__w").asc()], "__code")
    coded = rows.join(codes, F.col("__v") == F.col("__w"), "left")
    bucket = F.when(F.col("__code").isNull(), F.lit(1)).otherwise(F.bitmap_bucket_number("__code"))
    finest = coded.withColumn("__bucket", bucket).groupBy(*dims, "__bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("__code")).alias("__bits"))
    view = f"cube_{uuid.uuid4().hex}"
    finest.createOrReplaceTempView(view)
    names = ", ".join(f"`{d}`" for d in dims)
    sql = f"SELECT {names}, grouping_id() AS grouping_id, __bucket, bitmap_count(bitmap_or_agg(__bits)) AS __n FROM {view} GROUP BY __bucket, CUBE({names})"
    merged = df.sparkSession.sql(sql)
    df.sparkSession.catalog.dropTempView(view)
    return merged.groupBy(*dims, "grouping_id").agg(F.sum("__n").alias(name))
