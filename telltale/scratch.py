"""Tables in the shared folder: they cut the lineage, and what they hold survives lost executors."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names.

    Only where that setting is absent and Spark runs in one process (tests) a local folder is used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.conf.get("spark.master", "local").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/telltale-shared"
        self.dir = f"{root.rstrip('/')}/telltale-{uuid.uuid4().hex}"
        self.count = 0

    def named(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.dir}/{self.count}"
        df.write.parquet(path)
        return self.named(path, df.schema)

    def split(self, df: DataFrame, condition: Column) -> list[DataFrame]:
        """Writes df in one job as two tables, the rows without and those with the condition; each can be dropped."""
        self.count += 1
        path = f"{self.dir}/{self.count}"
        df.withColumn("__side", condition.cast("int")).write.partitionBy("__side").parquet(path)
        out = []
        for part in (f"{path}/__side=0", f"{path}/__side=1"):
            if not self.exists(part):  # no rows, no folder
                self.spark.createDataFrame([], df.schema).write.parquet(part)
            out.append(self.named(part, df.schema))
        return out

    def exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
