"""Sessions and what every query needs of one."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(app: str = "pricelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries expect; ``conf`` adds to them or replaces them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all machines share, in the one that spark.checkpoint.dir names; a local one where Spark runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    place = Path(tempfile.mkdtemp()) / f"pricelake-{os.getpid()}.zip"
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    sc.addPyFile(str(place))
