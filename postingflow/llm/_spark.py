"""Session helpers: tables, and tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import re

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, shared_folder

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI, and the path in it; Hadoop's names of S3 are known too."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads don't depend on any executor's local files.

    While it is written, batches to Python workers are held to 8 MB unless the session says otherwise. The table is
    removed by ``removed``, or when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    small = spark.conf.get(BATCH) == BATCH_DEFAULT  # nobody has chosen
    try:
        if small:
            spark.conf.set(BATCH, BATCH_BYTES)
        df.write.option("compression", codec).parquet(path)
    finally:
        if small:
            spark.conf.unset(BATCH)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rsplit("/", 1)[0])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct, ``row``: what is put beside it clashes with none of them."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))


def of_row(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(rows: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The packed columns again, in their order, and the new ones behind them in place of those so named, in any case."""
    taken = {c.lower() for c in new}
    return rows.select(*[of_row(c).alias(c) for c in columns if c.lower() not in taken], *[v.alias(c) for c, v in new.items()])
