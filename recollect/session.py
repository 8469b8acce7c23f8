"""Session helpers shared by tests, the bench and the command line."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "recollect", memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores if str(cores).isdigit() else 8),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Python workers import the package by name, wherever they start
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    env["PYTHONPATH"] = os.pathsep.join([root, *(p for p in paths if p != root)])
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and forget its plan.

    The folder is the session's ``spark.checkpoint.dir``.  Only where the session
    names none (tests, notebooks) a temporary folder of this machine is used, and
    only in local mode: on a cluster that would not be shared.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or os.environ.get("RECOLLECT_CHECKPOINT_DIR")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="recollect-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many partitions as there are cores.

    Files that are few and small would leave most cores idle in an expensive projection.  A
    scan with enough splits, so any large one, is returned as it is.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def spread_rows(rows: DataFrame) -> DataFrame:
    """Few but expensive rows, over all cores and at least the session's shuffle partitions."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
