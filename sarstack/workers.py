"""Let Python workers find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of one Arrow batch: texts of many KB make Spark's 10,000 rows too large for small executors.
ARROW_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    """Put this package's folder on the workers' path; send Arrow batches of ARROW_ROWS rows unless the session says otherwise.

    Enough where executors see the same folder (one machine, a shared
    installation). Elsewhere the package is shipped by ``--py-files``, and an
    entry for a folder that does not exist does no harm.
    """
    env = spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in path:
        env["PYTHONPATH"] = ":".join([ROOT, *path])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(rows):  # a value that was set stays, be it the default's
        spark.conf.set(rows, str(ARROW_ROWS))
