"""Python functions run where nothing but the driver knows where the package lies."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from trialforge import tables

CODE = """
import sys
sys.path.insert(0, {home!r})
from trialforge.plans import catalogue
from trialforge.session import get_session
spark = get_session(2, 2)
print("rows", catalogue.collect()[0]["kernel_moments"](spark, {sf!r}).count())
"""


def test_from_elsewhere(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(home=str(Path(__file__).resolve().parents[1]), sf=sf)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert re.search(r"rows [1-9]\d*", out.stdout), out.stderr[-2000:]


def test_scratch_folder_and_settle(spark, tmp_path):
    """On a cluster a shared folder must be named; a settled step leaves one table."""
    import os

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        tables.shared_dir(Cluster)
    n = tables.mark()
    a = tables.scratch(spark.range(5))
    b = tables.settle(tables.scratch(a.withColumnRenamed("id", "x")), n)
    assert tables.mark() == n + 1 and b.count() == 5 and not os.path.exists(a.inputFiles()[0].removeprefix("file://"))
    tables.drop_scratch(n)


def test_ordered(spark):
    """Positions, totals and earlier minima of a hot key, keys with nulls and ties, against a plain loop."""
    rows = [("hot" if i % 3 else None if i % 2 else "cold", (i * 7919) % 1000, float((i * 31) % 97)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    got = tables.ordered(df, ["k"], ["o"], "p", "n", {"before": "v"}).collect()
    want = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        seen = want.setdefault(k, [])
        seen.append((o, len(seen), min((x[3] for x in seen), default=None), v))
    assert len(got) == len(rows)
    for r in got:
        o, p, before, v = want[r.k][r.p]
        assert (r.o, r.p, r.n, r.v, r.before) == (o, p, len(want[r.k]), v, before)
    assert tables.ordered(df.limit(0), ["k"], ["o"]).count() == 0
    q = {r.k: r.m for r in tables.quantiles(df.fillna("none"), "k", "v", {"m": 0.3}).collect()}
    import numpy as np

    for k in ("hot", "cold", "none"):
        assert q[k] == pytest.approx(np.quantile([v for x, _, v in rows if (x or "none") == k], 0.3))
