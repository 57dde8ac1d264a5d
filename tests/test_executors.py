"""The library's own functions reach Python workers that start in another folder without the repository on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from hearthgrid.functions import geometry as G, text as T
from hearthgrid.operators import clip
from hearthgrid.plans import heat as H
line = spark.range(3).select("id", F.array(*[G.make_point(F.lit(float(x)), F.lit(0.0)) for x in (0, 1, 2)]).alias("g"))
print("ROWS", line.select(F.size(T.simplify("g", 0.1)).alias("n")).first()["n"])
print("ROWS", line.select(F.size(T.from_wkb(T.to_wkb("g", "line"), "line")).alias("n")).first()["n"])
box = lambda a, b: G.make_box(*[F.lit(float(v)) for v in (a, a, b, b)])
layer = spark.range(2).select("id", box(0, 4).alias("a"), F.array(box(2, 6)).alias("g"))
print("ROWS", clip.clip_multi(layer.select("id", "g"), "g", layer.select("a"), "a").select(G.area_multi("g").alias("n")).first()["n"])
rows = spark.createDataFrame([("T", "OuterWall", "c", 1900, 2000, 0, "m", 0.3, 0.8, 1000.0, 1500.0)], "building_type string, element_name string, "
    "construction_data string, start_year int, end_year int, layer_index int, material_name string, thickness double, thermal_conduc double, heat_capac double, density double")
print("ROWS", H.construction_table(rows).count())
"""


def test_other_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=ROOT, shared="file://" + str(tmp_path / "shared")))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and done.stdout.split() == ["ROWS", "2", "ROWS", "3", "ROWS", "4.0", "ROWS", "1"], done.stdout + done.stderr[-2000:]
