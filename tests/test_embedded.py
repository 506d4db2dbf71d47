"""A database in the driver's process, used from a cluster whose executors are processes of their own."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from arborfold.sources import store

place = sys.argv[1]
spark = SparkSession.builder.config(map={"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{place}/shared"}).getOrCreate()
store.EMBEDDED_ROWS = 4
got = entry.queries()["s09_jdbc_upsert"](spark, place).collect()
print("QUERY", sorted((tuple(r) for r in got), key=str))
url, kind = f"jdbc:derby:{place}/other;create=true", "id int, name string"
for rows, mode in (([(i, str(i)) for i in range(9)], "overwrite"), ([(9, None), (10, "")], "append"), ([(11, "x")], "ignore")):
    store.write_jdbc(spark.createDataFrame(rows, kind), url, "t", mode)
print("TABLE", sorted((tuple(r) for r in store.reader(spark, url)("t").collect())))
store.write_jdbc(spark.createDataFrame([], kind), url, "t", "overwrite")
print("EMPTY", store.reader(spark, url)("t").collect())
"""


def test_jdbc_from_a_cluster(tmp_path):
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write their logs to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    duckdb.execute(f"copy (select i as event_id, i % 3 as user_id, case when i <> 4 then 'it''s, \"' || i end as event_type, i / 4 as value from range(11) t(i)) to '{tmp_path}/events.parquet'")
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = dict(line.split(" ", 1) for line in done.stdout.splitlines() if line.split(" ")[0] in ("QUERY", "TABLE", "EMPTY"))
    assert said.keys() == {"QUERY", "TABLE", "EMPTY"}, done.stderr[-3000:]
    events = duckdb.execute(f"select event_id, user_id, event_type, value from '{tmp_path}/events.parquet' union all select -1, 1, 'new', 0.5").fetchall()
    assert said["QUERY"] == str(sorted(events, key=str))
    assert said["TABLE"] == str([(i, str(i)) for i in range(9)] + [(9, None), (10, "")])
    assert said["EMPTY"] == "[]"
