"""Session settings that the operators rely on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def build_session(app: str = "glyphmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC. Sizes of partitions stay the cluster's unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one under a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            # The driver and the tasks share the machine.
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: no lineage, and its true size.

    A checkpoint would keep the estimated size of its plan, and estimates of joins are products, so after
    some rounds of a loop planning is busy with numbers of thousands of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tables of known size are broadcast up to this number of rows, and joined by shuffle beyond; the results agree.
BROADCAST_ROWS = 500_000


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count of its rows allows it. For narrow tables that are written already."""
    return broadcast(df) if df.count() <= rows else df
