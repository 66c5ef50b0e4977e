"""Python workers import this package: from where it lies on one machine, from a shipped archive on a cluster."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_ARCHIVE = f"{_PACKAGE.name}_shipped.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Let workers import the package, wherever the driver was started.  Call it before operators that run Python; registered queries do.

    An archive is added once for each context; executors that start later, or in place of lost ones, fetch it too.
    """
    context = spark.sparkContext
    if context.master.split("[")[0] == "local":
        env, root = context.environment, str(_PACKAGE.parent)
        paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    elif not any(x.endswith(f"/{_ARCHIVE}") for x in context.listFiles):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(_PACKAGE.parent).as_posix())
        held = Path(tempfile.mkdtemp()) / _ARCHIVE  # read by the driver's file server alone
        held.write_bytes(data.getvalue())
        context.addPyFile(str(held))
    return spark
