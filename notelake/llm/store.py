"""Intermediate tables in the folder that driver and executors share.

A table that later steps read more than once, or that cuts a long lineage, is written as
Parquet below ``spark.checkpoint.dir``. A lost executor then costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a single local JVM.

    Raises ValueError where the setting is missing on a cluster, since no folder of one
    machine can stand in for it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="notelake-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/notelake/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    With ``key`` it lies in buckets of that column, so joins on it needn't shuffle it; until ``release`` it then has a
    name in the session's catalogue.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if key is not None:
        name = f"notelake_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
        out = spark.table(name)
        out._nl_stored_at, out._nl_name = path, name
        return out
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nl_stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if name := df.__dict__.get("_nl_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._nl_stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def constant(values: list | tuple, kind: str) -> Column:
    """An array constant of the bounded list ``values``, built from one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def hash_sample(df: DataFrame, max_rows: int, *keys: str) -> DataFrame:
    """At most ``max_rows`` rows, those with the smallest hashes of ``keys``, in no order.

    The limit is found over the hashes alone, so whole rows move only once they are chosen. Rows
    that tie at the limit fill it up in any order.
    """
    h = F.xxhash64(*keys)
    low = [r[0] for r in df.select(h.alias("h")).orderBy("h").limit(max_rows).collect()]
    return df.filter(h <= low[-1]).limit(max_rows) if low else df.limit(0)
