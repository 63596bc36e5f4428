"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "auditloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_cleaned: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``, else one below the session's warehouse folder.

    The driver and all executors must reach it: without a named folder a local warehouse is an error unless the master is
    local, too. What this application wrote there is removed when the session is stopped or Python ends.
    """
    sc = spark.sparkContext
    if sc.applicationId in _cleaned:
        return
    if not sc._jsc.sc().getCheckpointDir().isDefined():  # Spark itself sets a folder that is named when it starts
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        folder = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/auditloom-checkpoints"
        if not named and folder.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise ValueError(f"{folder} is a folder of the driver alone; set spark.checkpoint.dir to one that all executors reach")
        sc.setCheckpointDir(folder)
    _cleaned.add(sc.applicationId)
    atexit.register(_remove_checkpoints, sc)
    stop = sc.stop

    def remove_and_stop() -> None:
        _remove_checkpoints(sc)
        stop()

    sc.stop = remove_and_stop  # a session stops its context through this name


def _remove_checkpoints(sc) -> None:
    """Delete this application's own folder; nothing to do if the context was stopped, and so cleaned, before."""
    if sc._jsc is None:
        return
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(own.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each application.

    The archive is made on the driver and served by Spark's own file server, so that no installation on the executors
    is needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="auditloom-")) / "auditloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``cut``, as a compressed table of columns: for many narrow rows, of which a checkpoint takes several times the bytes.

    The shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


#: Without it shuffle files stay until the driver collects its garbage, so those of all steps of a query add up on disk.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, inside the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"
