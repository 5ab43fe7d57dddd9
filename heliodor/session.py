"""Session creation and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "heliodor", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; `conf` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="heliodor-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "heliodor.zip"), "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(os.path.join(folder, "heliodor.zip"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in `spark.checkpoint.dir`.

    Only where that setting is absent (a single local JVM, as in tests) a temporary folder stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="heliodor-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # the JVM is gone: the cluster's own clean-up has to take the folder
            pass


atexit.register(lambda: _remove([*_written, *_kept]))


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that `materialise` writes inside, once the results made of them have been consumed there.

    Without it they stay until the process ends, as a lazy result may read them at any time.
    """
    since = len(_written)
    try:
        yield
    finally:
        _remove(_written[since:])
        del _written[since:]


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back; with `keep` it stays until the process ends.

    This cuts the lineage and survives the loss of executors. The columns are kept by name and pruned on later reads.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"heliodor-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    (_kept if keep else _written).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores, for a stage of costly Python work.

    A scan that already gives a task to each core, as every large table's does, stays as it is. A table in one small file is
    spread by the hash of `keys`, which a lost task repeats alike.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
