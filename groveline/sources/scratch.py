"""Shared scratch space for checkpoints and intermediate files."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, *, required: bool = True) -> str | None:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session (``local[...]``) gets a fresh
    temporary folder. A cluster session does not, because a machine-local folder
    loses data with the machine: it is refused, or, if not ``required``, goes without and
    warns.
    """
    context = spark.sparkContext
    # a classic session's runtime config does not list core settings, its context does
    named = context.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", context.master):  # local-cluster has executors of its own
        if not required:
            warnings.warn(f"{_SETTING} is not set: long lineages are not cut", stacklevel=2)
            return None
        raise ValueError(f"set {_SETTING} to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(fresh)
    return fresh


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared folder, on whatever store that is."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not in the shared folder")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
