"""What the operators share: reading a table, cutting lineage, words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs outside these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and no others: extra columns of a wider table never clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Rows in a batch that goes to Python. Texts are long: Spark's own 10,000 would hold tens of megabytes on either side.
BATCH_ROWS = 1000


def batched(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are small enough for whole texts."""
    spark = docs.sparkSession
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; a cluster has to name its own, as each executor would write to its own disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="inkweave-"))
        place = _OWN[0]
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage ends there, on files
    that a lost executor doesn't take along. Parquet keeps columns prunable and typed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes what :func:`stored` wrote, for a frame that no later step reads."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more. It does so when the driver collects
    garbage, which on its own may be long after the next steps have filled the disks."""
    gc.collect()
    spark._jvm.System.gc()


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
