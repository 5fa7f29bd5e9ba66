"""Places in the folder that driver and executors share, for what must outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below ``spark.checkpoint.dir`` that no other call gets; on a single local JVM without that setting, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="notelake-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = f"file://{_own[app]}"
    return f"{found.rstrip('/')}/notelake/{uuid.uuid4().hex}/{label}"


def local_path(folder: str) -> str:
    """The plain path of a folder that every machine mounts; files that no Spark reader opens need one."""
    scheme, _, rest = folder.rpartition("://")
    if scheme not in ("", "file"):
        raise ValueError(f"{folder} isn't a mounted folder")
    return rest.removeprefix("file:")


def give_back() -> None:
    """Return a worker's free memory to the system, as idle workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
