from pyspark.sql import functions as F

from telespark.llm.common import hash_share


def test_share_of_hashes(spark):
    ids = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    low = ids.where(hash_share(F.col("h"), 1000, 20_000))
    # The lowest hashes are all there, so an ordered limit behind it gives the same rows.
    assert 1000 <= low.count() < 1600
    assert low.orderBy("h").limit(1000).collect() == ids.orderBy("h").limit(1000).collect()
    assert ids.where(hash_share(F.col("h"), 20_000, 20_000)).count() == 20_000
    assert ids.where(hash_share(F.col("h"), 5, 0)).count() == 20_000
