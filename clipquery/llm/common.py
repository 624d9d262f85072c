"""What several operators of this subpackage share: the shared folder and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where no folder is set and Spark runs in one process, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset a folder of this machine is
    taken, but only in local mode: on a cluster other machines couldn't read it, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_FOLDER)
    return LOCAL_FOLDER


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it.

    This cuts the lineage: a lost executor costs the tasks that it ran, never the stages before the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/clipquery/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it in any case."""
    have = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name.lower() in have:
            name = "_" + name
        return name

    return [free(n) for n in names]


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote and nothing reads any more; other files stay."""
    for df in frames:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        own = place(f"{shared_folder(spark)}/clipquery")
        own = own.getFileSystem(conf).makeQualified(own).toString()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = place(path)
            at = at.getFileSystem(conf).makeQualified(at)
            if at.getParent().toString() == own:
                at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
