"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Arrow batches that feed HTML parsing: a landed page is 1-100 KB, so a few
# hundred rows per batch keeps a Python worker's memory flat; the byte cap
# bounds a batch of unusually large pages as well.
HTML_BATCH_ROWS = 256
HTML_BATCH_BYTES = 64 << 20


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "sitesift") -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(HTML_BATCH_ROWS))
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(HTML_BATCH_BYTES))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITESIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_TEST_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, as
    ``spark.checkpoint.dir`` names it.

    Only a single-process ``local`` or ``local[n]`` session (tests, benches)
    that names none gets a folder of its own; anywhere else a machine-local
    folder would lose data with its executor, so an unset setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if sc.applicationId not in _TEST_ROOTS:
            _TEST_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="sitesift-ckpt-")
        path = _TEST_ROOTS[sc.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/sitesift/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sitesift`` importable in the Python workers (the HTML jobs and
    pandas UDFs run code from it there): zip the package, write the zip into
    the shared checkpoint folder and ``addPyFile`` it, once per application.
    A no-op when the session has no SparkContext (e.g. Spark Connect)."""
    import hashlib
    import io
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in sorted(os.walk(pkg_dir)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    arc = os.path.join("sitesift", os.path.relpath(full, pkg_dir))
                    zf.writestr(zipfile.ZipInfo(arc, (2020, 1, 1, 0, 0, 0)), open(full, "rb").read())
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    if (app, digest) in _SHIPPED:
        return
    path = f"{checkpoint_root(spark)}/sitesift-pkg/sitesift-{digest}.zip"
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    _SHIPPED.add((app, digest))
