"""Session settings, and the package's way to Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "weftgraph", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and Arrow; settings given win."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false", **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of an Arrow batch sent to a Python worker, unless the session already asks for fewer.
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once, and send it this package (once for each application)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="weftgraph-"), "weftgraph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted([*top.rglob("*.py"), *top.parent.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
