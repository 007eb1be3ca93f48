"""What a session needs before it runs this package's functions on executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, so that workers anywhere can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(f"{root.name}/{path.relative_to(root)}", (2020, 1, 1, 0, 0, 0)), path.read_bytes())
        folder = Path(tempfile.mkdtemp(prefix="quire-"))
        (folder / "quire_package.zip").write_bytes(buffer.getvalue())
        sc.addPyFile(str(folder / "quire_package.zip"))
        _SHIPPED.add(sc.applicationId)
    return spark
