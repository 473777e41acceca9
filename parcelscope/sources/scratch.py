"""Where derived tables are written: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
# of stored input: it is many times larger as rows in memory, and a task sorts what it writes
BYTES_PER_TASK = 16 << 20
# where whole rows are sorted before they are written
BYTES_PER_SORT = 4 << 20
MAX_TASKS = 50_000

_local_roots: dict[str, tempfile.TemporaryDirectory] = {}
_written: dict[tuple, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one derived table.

    Only a local session without the setting gets a temporary folder of this machine, because there the one machine
    holds the driver and all tasks; it is removed when the program ends.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.TemporaryDirectory(prefix="parcelscope-", ignore_cleanup_errors=True)
        root = _local_roots[app].name
    return f"{root.rstrip('/')}/parcelscope/{name}-{uuid.uuid4().hex}"


def write_once(
    spark: SparkSession, name: str, inputs: list[str], write: Callable[[str, int], None], bytes_per_task: int = BYTES_PER_TASK
) -> str:
    """Path of a table derived from input files.

    The first call of an application writes it, with as many tasks as the size of the inputs asks for; later calls
    find it again until one of the inputs changes.
    """
    size, mark = _files(spark, inputs)
    made = (spark.sparkContext.applicationId, name, tuple(inputs), mark)
    if made not in _written:
        path = scratch_path(spark, name)
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // bytes_per_task))
        write(path, min(tasks, MAX_TASKS))
        _written[made] = path
    return _written[made]


def _files(spark: SparkSession, paths: list[str]) -> tuple[int, tuple]:
    """Total bytes of files or folders, and a mark that changes when one of them does; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    row = found.agg(F.sum("length"), F.count(F.lit(1)), F.max("modificationTime")).first()
    return row[0] or 0, tuple(row)
