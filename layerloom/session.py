"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the package expects of a session; set where a caller has set nothing.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Rows of an Arrow batch where the session leaves that open: texts are long, and a worker holds a batch several times.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
_shipped: set[str] = set()


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that they need no copy of the repository."""
    if spark.conf.get(ARROW_ROWS[0], None) is None:
        spark.conf.set(*ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        to = os.path.join(tempfile.mkdtemp(prefix="layerloom-"), f"{top.name}.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)
    return spark
