"""Incremental merge: catalogs arrive as a stream of variants, the merged table follows.

Each micro-batch is appended to a table of variants partitioned by a hash of the uid; only
the partitions that it touches are merged again. A batch that is replayed after a failure
replaces its own rows, so the result is the same as of one batch merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class IncrementalMerge:
    def __init__(self, variants_path: str, merged_path: str, merge, buckets: int = 64):
        """``merge``: DataFrame of variants -> merged DataFrame with a column uid."""
        self.variants_path, self.merged_path, self.merge, self.buckets = variants_path, merged_path, merge, buckets
        self.built = False

    def add(self, batch: DataFrame, batch_id: int) -> None:
        if self.built:
            raise RuntimeError("the merge is finished")
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("uid"), F.lit(self.buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket).withColumn("batch", F.lit(batch_id))
        overwrite = {"partitionOverwriteMode": "dynamic"}
        rows.write.mode("overwrite").options(**overwrite).partitionBy("bucket", "batch").parquet(self.variants_path)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            variants = spark.read.parquet(self.variants_path).filter(F.col("bucket").isin(touched)).drop("bucket", "batch")
            merged = self.merge(variants).withColumn("bucket", bucket)
            merged.write.mode("overwrite").options(**overwrite).partitionBy("bucket").parquet(self.merged_path)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add).trigger(availableNow=True).start()

    def build(self, spark) -> DataFrame:
        self.built = True
        return spark.read.parquet(self.merged_path).drop("bucket")
