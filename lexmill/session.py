"""Sessions, the shared checkpoint folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "512k")  # small files are read by several tasks
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where none is set and Spark runs on this machine, a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexmill-ckpt-"))


def parts_for(*tables: DataFrame, rows: int = 1 << 20) -> int | None:
    """How many partitions hold at most about ``rows`` rows of the tables each; None if Spark's own number is enough."""
    spark = tables[0].sparkSession
    least = -(-sum(t.count() for t in tables) // rows)
    return least if least > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over ``parts`` partitions, which joins and windows on them keep; None leaves it to Spark."""
    return df.repartition(parts, *keys) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name inside the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


#: Tables cut inside this thread's open scratch blocks, innermost last. Threads that share a session don't see each other's.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open_scratch", default=())
#: Held while adaptive execution is off for a session, so that what is set back is what was there.
_adaptive = RLock()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the checkpoints of tables cut inside once the block ends without an error, but for those given to ``keep``.

    Nothing that is read later may depend on a table that goes. Blocks belong to the thread that opened them.
    """
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _open.set((*_open.get(), mine))
    try:
        yield keep
        for df in mine:
            if not any(df is k for k in kept):
                drop(df)
    finally:
        _open.reset(token)
        if _open.get():
            _open.get()[-1].extend(kept)
        mine.clear()
        tidy(spark)


def drop(df: DataFrame) -> None:
    """Remove the checkpoint of a table that ``cut`` wrote and that nothing will read again."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffles that no table refers to any more; it does so when the driver collects its garbage."""
    spark._jvm.System.gc()


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    Later stages then read the same rows whatever executors are lost, and the plan stays short. With ``placed``
    Spark goes on knowing how the rows are partitioned, so joins on those keys don't move them again (adaptive plans
    forget it).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if placed:
        with _adaptive:
            adaptive = spark.conf.get("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            try:
                out = df.select("*").checkpoint(eager=True)
            finally:
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    else:
        out = df.select("*").checkpoint(eager=True)
    if _open.get():
        _open.get()[-1].append(out)
    return out


def ship_package(spark: SparkSession) -> None:
    """Give executors this package where they can't import it from PYTHONPATH or the working folder."""
    here = str(ROOT)
    if os.getcwd() == here or here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    done = spark.sparkContext.__dict__.setdefault("_lexmill_shipped", [])
    if not done:
        target = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted((ROOT / "lexmill").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(target))
        done.append(target)
