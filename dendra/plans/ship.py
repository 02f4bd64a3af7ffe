"""The library's own code for Python workers on other machines."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
#: Date of the archive's entries: equal code makes an equal archive.
DATE = (2000, 1, 1, 0, 0, 0)

_shipped: set[str] = set()


def archive() -> bytes:
    """The package and the modules beside it, zipped."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted([*ROOT.glob("*.py"), *ROOT.glob("dendra/**/*.py")]):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(ROOT)), DATE), p.read_bytes())
    return out.getvalue()


def to_workers(spark: SparkSession) -> None:
    """Puts this code on the Python workers' path: by its folder, and on a cluster by an archive in ``spark.checkpoint.dir``,
    once a session."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared or sc.applicationId in _shipped or (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        return
    data = archive()
    as_path = sc._jvm.org.apache.hadoop.fs.Path
    target = as_path(f"{shared}/dendra-code-{hashlib.sha256(data).hexdigest()[:16]}.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target):
        part = as_path(f"{target.toString()}.{sc.applicationId}")
        stream = fs.create(part)
        stream.write(bytearray(data))
        stream.close()
        if not fs.rename(part, target) and not fs.exists(target):
            raise OSError(f"{target.toString()} can't be written")
    sc.addPyFile(fs.makeQualified(target).toString())
    _shipped.add(sc.applicationId)
