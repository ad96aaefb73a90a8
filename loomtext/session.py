"""Session helpers.

The cluster owns ``spark.checkpoint.dir``; we only set one when it is unset
(local tests), and then inside a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "loomtext") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote sessions manage checkpoints server-side
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="loomtext-ckpt-")  # local tests and the bench only
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(base, "tables", f"{name}-{os.urandom(6).hex()}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into spark.checkpoint.dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def uncut(df: DataFrame) -> None:
    """Delete the files of a ``cut_lineage`` that nothing reads any more.  Spark does so
    once the driver has collected the plans that read them, which may take rounds."""
    spark = df.sparkSession
    at = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if at.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition count)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``loomtext`` importable in executor Python workers (``--py-files``).

    Operators that run Python on executors (mapInArrow, pandas UDFs) pickle
    references to package functions; the workers must be able to import the
    package.  Zips the installed package once per application and adds it with
    ``addPyFile`` (``addArtifacts`` on a remote session).
    """
    import zipfile

    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = f"remote-{id(spark)}"
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="loomtext-pyfiles-")
    zpath = os.path.join(out_dir, "loomtext.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("loomtext", os.path.relpath(full, pkg_dir)))
    try:
        spark.sparkContext.addPyFile(zpath)
    except Exception:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(app)
