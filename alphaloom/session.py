"""A local session with the settings the tests and the bench use."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "alphaloom", **conf: str) -> SparkSession:
    """Settings of an existing session win; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Size of Arrow batches: what Spark sets by default, and what takes its place, so that a few batches of long rows don't outgrow a worker. Other values are left alone.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000")}

_shared: set[str] = set()


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: it is shipped once to each application as a zip file, so no folder need exist on every machine."""
    app = spark.sparkContext.applicationId
    for key, (usual, bounded) in BATCHES.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, bounded)
    if app not in _shared:
        root, data = Path(__file__).resolve().parent.parent, io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted([*root.glob("alphaloom/**/*.py"), *root.glob("corpus_pipeline.py")]):
                z.writestr(zipfile.ZipInfo(str(path.relative_to(root))), path.read_bytes())
        folder = Path(tempfile.mkdtemp(prefix="alphaloom-code-"))
        at = folder / f"alphaloom-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
        at.write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(str(at))
        _shared.add(app)
    return spark
