"""New folders that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in a temporary one where that is unset and the master is local (tests)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _made:
            _made[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _made[app], ignore_errors=True)
        base = _made[app]
    return f"{base.rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"
