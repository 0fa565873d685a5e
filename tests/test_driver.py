"""The driver's situation: its own plain session, a working directory outside the repo.
Python workers must still import the package (pandas-UDF jobs), and entry() must run."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
q = E.queries()
print("RESULT", E.entry(spark).count(), q["rate_limit_sliding_batch"](spark, "/root/testdata/sf0.001").count(),
      spark.conf.get("spark.sql.session.timeZone"))
spark.stop()
"""


def test_plain_session_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="driver-")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, n_entry, n_limiter, tz = line[0].split()
    assert int(n_entry) > 0 and int(n_limiter) > 0 and tz == "UTC"


KEYED = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
from parcelwise.plans import check
from parcelwise.streaming.jobs import PROVIDER
before, q, sql, duck = spark.conf.get(PROVIDER), E.queries(), E.oracle_sql(), check.duck("/root/testdata/sf0.001")
for name in ("connection_subscriptions", "connection_stats", "stream_queue"):
    print("RESULT", name, *check.compare(q[name](spark, "/root/testdata/sf0.001"), duck, sql[name]))
assert before.endswith("HDFSBackedStateStoreProvider") and spark.conf.get(PROVIDER) == before
print("RESULT end")
spark.stop()
"""


def test_keyed_state_in_a_plain_session():
    """Spark's default state store, and a driver that has the package on no path of its workers."""
    cwd = tempfile.mkdtemp(prefix="driver-")
    out = subprocess.run([sys.executable, "-c", KEYED], cwd=cwd, capture_output=True, text=True, timeout=600)
    lines = [x.split() for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert len(lines) == 4 and all(x[2] == "True" for x in lines[:3]), out.stdout[-1000:] + out.stderr[-2000:]
