"""Session, materialisation and join helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and found to have no more rows than this.
BROADCAST_ROWS = 200_000
#: Joins of no more rows than this aren't salted: one task could take them all.
SALT_ROWS = 500_000


def session(app: str = "millrace", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests, benches and small runs; a cluster passes its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset, a local run (or a test)
    gets a folder of its own; on a cluster, whose executors wouldn't share it, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session; they may have no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_package.zip")  # read by this driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._millrace_shipped = True


def materialised(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """As materialise, with measures of the rows (aggregates such as a count) taken while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage: what is read again survives the loss of any executor, and the
    planner knows its true size.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A new place for an intermediate table. What lies there is deleted when the session's process ends."""
    own = f"{scratch(spark)}/millrace/{spark.sparkContext.applicationId}"
    if own not in _swept:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _swept.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def prepared(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, built by the first one of the session and written to the shared folder.

    It is built anew if any of the input paths has other files, sizes or times than when it was written, or if its own files are gone.
    """
    key = (spark.sparkContext.applicationId, name, file_states(spark, inputs))
    held = _prepared.get(key)
    if held is None or not _stored(spark, held[0]):
        path = new_path(spark)
        df = build()
        df.write.parquet(path)
        held = _prepared[key] = (path, spark.read.schema(df.schema).parquet(path))
    return held[1]


def _stored(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def file_states(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Files of some paths with their sizes and times."""
    state = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
            held = f.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(f.getPath())
            state += [(str(x.getPath()), x.getLen(), x.getModificationTime()) for x in held]
    return tuple(sorted(state))


_swept: set[str] = set()
_prepared: dict[tuple, tuple[str, DataFrame]] = {}


def forget(df: DataFrame) -> None:
    """Delete a table written by materialise that no later step reads."""
    spark = df.sparkSession
    for path in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/millrace/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a materialised table, has at most that many rows."""
    return df.count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count proves it small, else df as it is.

    Left unmarked, the join shuffles and adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys that hold more than a share of all rows: at most 1/share of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_hot_rows"))
    total = df.agg(F.count(F.lit(1)).alias("_all_rows"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("_hot_rows") > F.lit(share) * F.col("_all_rows")).select(key)


def salted_join(big: DataFrame, other: DataFrame, key: str, how: str = "inner", rows: int | None = None, salts: int = 32, share: float = 0.01) -> DataFrame:
    """Equi-join on one key whose hot values in big are spread over salts.

    other has one row for a key; its rows for hot keys are copied once a salt. The hot keys
    number at most 1/share, so they are broadcast. The salt is a hash of big's whole row:
    a task run again after a loss makes the same one. Up to SALT_ROWS rows in all can't
    overload a task and are joined as they are; rows is a known bound of big's.
    """
    if (big.count() if rows is None else rows) <= SALT_ROWS:
        return big.join(other, key, how)
    hot = materialise(hot_keys(big, key, share).withColumn("_hot", F.lit(True)))
    if hot.isEmpty():
        return big.join(other, key, how)
    hot = F.broadcast(hot)
    left = big.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")).otherwise(0)
    )
    right = other.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_hot").join(right.drop("_hot"), [key, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, by: Column, task_bytes: int = 4 << 20) -> DataFrame:
    """df dealt over tasks by a hash, for work that costs much for each byte: about task_bytes of the planner's estimate a task.

    The number is explicit, so adaptive execution doesn't put small partitions together again. No fewer than three tasks a core.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # rows of the driver's have no estimate
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, min(100_000, known // task_bytes)), by)


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns only, so that extra columns can't clash with those made here."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])
