"""Tables in the folder that driver and executors share: written once, read by what follows, removed when nothing reads them any more."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a session in local mode that names none, by the session's application.
_LOCAL: dict[str, str] = {}
#: Folders and tables written since :func:`scope` named one, by that name.
_SCOPES: dict[str, list[str]] = {}
_scope = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode (as in tests) gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="bulletin-")
        found = _LOCAL[context.applicationId]
    return found.rstrip("/")


def noted(path: str) -> str:
    """The folder, or `table:` and a name, as something that the scope owns."""
    if _scope:
        _SCOPES.setdefault(_scope, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    short_plans(spark)
    path = noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_folder", path)
    return out


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared folder and `table:` names."""
    context = spark.sparkContext
    for path in paths:
        if path.startswith("table:"):
            spark.sql(f"drop table if exists {path[6:]}")
        else:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def forgotten(*tables: DataFrame) -> None:
    """Removes tables of :func:`written` that no result reads any more."""
    for t in tables:
        dropped(t.sparkSession, t._folder)


def scope(spark: SparkSession, name: str, after: str = "") -> None:
    """From now on, what is written belongs to `name`, or to nothing. What belonged to `after` is removed: its results have been written elsewhere."""
    global _scope
    _scope = name
    dropped(spark, *_SCOPES.pop(after, []))


#: Letters of a plan's description, which the driver makes anew and keeps whenever adaptive execution changes a plan: a plan of a hundred exchanges has megabytes of them.
DESCRIBED, _LETTERS = "20000", "spark.sql.maxPlanStringLength"


def short_plans(spark: SparkSession) -> None:
    """From now on, plans are described in few letters, unless the session says how many they may have."""
    if spark.conf.get(_LETTERS).rstrip("b") == str((1 << 31) - 1 - 15):
        spark.conf.set(_LETTERS, DESCRIBED)


#: Bytes of rows that go to a Python worker at once, where the session leaves it to Spark: both sides hold a few such batches.
BATCH, _KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python in small batches, unless the session says how large they are to be."""
    if spark.conf.get(_KEY).rstrip("b") == str(64 << 20):
        spark.conf.set(_KEY, BATCH)
