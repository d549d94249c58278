"""Sends this package's modules to the executors, once a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Python workers can then import what the driver imports, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        out = os.path.join(tempfile.mkdtemp(), "vecspark.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in [*sorted((ROOT / "vecspark").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(out)
        _sent.add(sc.applicationId)
    return spark
