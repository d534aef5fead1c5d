"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``; they cut lineage in iterative operators.

A session's tables stay as long as results that read them may run; ``clear`` deletes them once results are written.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.__dict__.setdefault("_ledgerloom_dir", None) or tempfile.mkdtemp(prefix="ledgerloom-")
        spark.__dict__["_ledgerloom_dir"] = path
    return path.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Delete the tables that this application has written; results that still read them can't be computed again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
