"""What a Python function over texts gets at once is bounded by bytes."""

import pandas as pd
from pyspark.sql import functions as F

from quarry.session import BYTES, table


def test_a_batch_of_long_texts_is_small(spark, sf_dir):
    was = spark.conf.get(BYTES[0])
    try:
        spark.conf.unset(BYTES[0])
        table(spark, sf_dir, "documents")

        @F.pandas_udf("long")
        def rows(t: pd.Series) -> pd.Series:
            return pd.Series([len(t)] * len(t))

        texts = spark.range(2000, numPartitions=1).select(F.repeat(F.col("id").cast("string"), 8000).alias("t"))
        assert texts.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < 500
        spark.conf.set(BYTES[0], "8m")  # a session's own choice stays
        table(spark, sf_dir, "documents")
        assert spark.conf.get(BYTES[0]) == "8m"
    finally:
        spark.conf.set(BYTES[0], was)
