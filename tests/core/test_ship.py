"""Workers on other machines import the library from an archive: a cluster session outside this folder, without it on the path."""

import os
import subprocess
import sys
import zipfile
from io import BytesIO
from pathlib import Path

import pyspark

from dendra.plans import ship

SCRIPT = """
import sys
root, shared = sys.argv[1:]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,1,512]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", shared).config("spark.driver.memory", "512m").config("spark.executor.memory", "512m").config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1").getOrCreate())
sys.path.append(root)
from dendra.plans import ship
ship.to_workers(spark)
spark.sparkContext.environment.pop("PYTHONPATH")  # only the archive is left
def where(batches):
    import dendra.schemas
    for b in batches:
        yield b.assign(path=dendra.schemas.__file__)
print("FROM", spark.range(1).mapInPandas(where, "id long, path string").first()["path"])
spark.stop()
"""


def test_archive():
    names = zipfile.ZipFile(BytesIO(ship.archive())).namelist()
    assert "__spark_entry__.py" in names and "dendra/plans/ship.py" in names and ship.archive() == ship.archive()


def writable_home(tmp_path):
    """A Spark home of links: workers of a local cluster make a folder in it, where the installed one may be read-only."""
    home = tmp_path / "home"
    home.mkdir()
    for entry in Path(pyspark.__file__).parent.iterdir():
        if entry.name != "work":
            (home / entry.name).symlink_to(entry)
    return str(home)


def test_workers_import_the_archive(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_HOME": writable_home(tmp_path)}
    (tmp_path / "run.py").write_text(SCRIPT)
    (tmp_path / "shared").mkdir()
    root = str(Path(__file__).resolve().parents[2])
    got = subprocess.run(["timeout", "300", sys.executable, "run.py", root, str(tmp_path / "shared")], cwd=tmp_path, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
    logs = "".join(p.read_text(errors="replace") for p in sorted((tmp_path / "home").glob("work/*/*/stderr")))
    assert [w for w in got.stdout.split("\n") if w.startswith("FROM") and "dendra-code-" in w], f"exit {got.returncode}\n{got.stdout}\n{logs}"
    assert (tmp_path / "home" / "work").is_dir()
