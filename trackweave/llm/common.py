"""What the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rules define it.
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}

_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Adds the paths that new_folder() gives out meanwhile."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders[:] = [x for x in _recorders if x is not paths]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine (master local) gets a temporary folder, and any other
    the SQL warehouse, which is shared too.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master.startswith("local") and not master.startswith("local-cluster"):
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="trackweave-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        return "file://" + _own["dir"]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_trackweave"


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: DataFrame):
    """Removes what is saved within, but for the tables appended to the list that it yields; nothing else may be read afterwards."""
    paths: list[str] = []
    kept: list[DataFrame] = list(keep)
    with recorded(paths):
        yield kept
    stay = {df.trackweave_path for df in kept}
    for path in paths:
        if path not in stay:
            drop_saved(spark, path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Sets the session's settings meanwhile, for queries that run within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def own_folder(spark: SparkSession) -> str:
    """Where this application saves its tables."""
    return f"{shared_folder(spark)}/trackweave/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has saved. For its end: results that were not written are lost."""
    drop_saved(spark, own_folder(spark))


def new_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path below the shared folder. keep: for as long as the application lives, whoever records."""
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    for paths in [] if keep else _recorders:
        paths.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.trackweave_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that saved() returned; nothing may be left that reads them."""
    for df in tables:
        drop_saved(df.sparkSession, df.trackweave_path)


def drop_saved(spark: SparkSession, path: str) -> None:
    """Removes a folder that new_folder() named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it, also in lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def c(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than are needed to tell."""
    return df.limit(most + 1).count() <= most


def lookup(left: DataFrame, right: DataFrame, on, how: str, most: int) -> DataFrame:
    """left joined with right, which is broadcast only if it holds at most so many rows; beyond that both are shuffled and AQE splits hot keys."""
    return left.join(F.broadcast(right) if small(right, most) else right, on, how)
