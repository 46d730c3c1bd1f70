"""The package on the executors."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


@cache
def _archive() -> Path:
    """This package as it was when the process first needed it, so that workers have what the driver runs."""
    top = Path(__file__).parent
    files = {p.relative_to(top.parent): p.read_bytes() for p in sorted(top.rglob("*.py"))}
    name = hashlib.sha256(b"".join(str(k).encode() + v for k, v in files.items())).hexdigest()[:16]
    path = Path(tempfile.mkdtemp(prefix="docloom-")) / f"{top.name}-{name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k, v in files.items():
            z.writestr(str(k), v)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that it needn't be installed where executors run; once for each session's context."""
    path = _archive()
    if path.name not in spark.sparkContext._python_includes:
        spark.sparkContext.addPyFile(str(path))
