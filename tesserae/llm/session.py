"""Session helpers that the corpus operators share: inputs, lineage cuts, bucket counts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds between two collections of the driver's garbage.
COLLECT_S = 5
_collected = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back, so that its lineage ends here.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where none is named
    (single-machine tests) a temporary one is made. What is read back has the size of its files as statistics.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if time.monotonic() - _collected[0] > COLLECT_S:
        # Shuffle files of lineages cut before are deleted once the driver has collected their garbage.
        gc.collect()
        sc._jvm.System.gc()
        _collected[0] = time.monotonic()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table from ``cut`` that nothing will read any more."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_count(rows: int, per_bucket: int, least: int = 64) -> int:
    """Number of exchange buckets: it follows the rows, so that one bucket stays of bounded size."""
    return int(max(least, -(-rows // per_bucket)))


def hashed_semi(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows whose key may be among ``ids`` and rows whose key surely is not.

    Keys are compared by a ``bits``-bit hash, so what is broadcast has at most 2**bits rows however
    large ``ids`` is; once it is saturated it prunes less but stays right.
    """
    name = unused("_slot", df)
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits)).cast("int")
    slots = F.broadcast(ids.select(slot(id_col).alias(name)).distinct())
    tagged = df.withColumn(name, slot(key))
    return tagged.join(slots, name, "left_semi").drop(name), tagged.join(slots, name, "left_anti").drop(name)
