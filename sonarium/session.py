"""Session settings, table access and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator broadcasts after counting it; a row is a few hundred bytes at most.
BROADCAST_ROWS = 20_000


def get_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sonarium") -> SparkSession:
    """A local session with the settings that tests and the bench use; on a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SONARIUM_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made by this process where none is set, and the tables it stored, by application.
_OWN: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a folder of
    its own, removed at the end of the process; on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sonarium_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{what}_{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; what cannot be told is an error, not a no."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that no frame in use reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
        _STORED[df.sparkSession.sparkContext.applicationId].remove(path)


def release(spark: SparkSession) -> int:
    """Deletes all tables this application stored and returns their number; to be called when no result of an operator is read any more."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, so that the join is a shuffled one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(df: DataFrame, **columns) -> DataFrame:
    """``df`` with the given columns, each computed once a row.

    Chained projections are merged by the optimizer, which repeats an expression at each use; a generate over an array of
    one struct stops that and keeps plans small, at the price of one narrow step.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select("*", F.explode(F.array(one)).alias("_held")).select(*kept, *[F.col("_held")[n].alias(n) for n in columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as the cluster keeps busy, by ``keys``: for small rows that cost much time each, which
    adaptive execution would otherwise put together by their size."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
