"""Column expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiarium.scratch import materialize
from apiarium.shipping import ship

#: Bytes of a batch between Spark and Python; tasks hold a few of them.
BATCH = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and bound the batches that they get, by bytes as well as rows."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that no column bears."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns, the file and the number in it of each row, and their names.

    The rows of a Parquet table have that by themselves; any other frame is written first.
    """
    place = [fresh("_file", docs.columns), fresh("_row", docs.columns)]

    def named(table: DataFrame) -> DataFrame:
        meta = table.metadataColumn("_metadata")
        return table.select(*columns(table), meta.getField("file_path").alias(place[0]), meta.getField("row_index").alias(place[1]))

    # only of a table itself: what has been joined or exploded repeats the numbers
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return named(docs), place
        except AnalysisException:  # another file format
            pass
    return named(materialize(docs, "rows")), place


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
