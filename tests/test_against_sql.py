"""Queries against their SQL on small tables that are made for a case."""

import duckdb
import pandas as pd

from trialforge.operators import windows
from trialforge.plans import catalogue

from .test_queries import canon

QUERIES, SQL = catalogue.collect()


def both(spark, folder, name, **tables):
    """The query's rows and its SQL's, on pandas tables."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t, rows in tables.items():
        con.register("rows", rows)
        con.execute(f"COPY rows TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return canon(QUERIES[name](spark, str(folder)).toPandas()), canon(con.execute(SQL[name]).df())


def test_muscle_numbers_of_three_digits(spark, tmp_path):
    got, want = both(spark, tmp_path, "muscle_alias", supplier=pd.DataFrame({"s_suppkey": [1, 7, 10, 42, 99, 100, 101, 998, 12345]}))
    assert got == want


#: Samples around a stimulus, the eleventh. Peaks of 1.0368125, and of zero or half of it where a sum's last bit decides.
WINDOWS = (
    [24.86, 34.5, 16.46, 14.34, 7.94, 5.35, 139.29, 45.39, 31.87, 33.03, 45.54, 37.54, 72.42],
    [37.61, 19.89, 3.53, 88.63, 21.77, 62.33, 20.24, 100.97, 9.2, 23.09, 43.89, 130.93, 35.56, 39.61, 45.08],
    [36.32, 21.16, 10.52, 62.42, 83.73, 29.99, 6.7, 42.16, 14.89, 98.26, 82.62, 54.93, 43.43, 7.67, 52.65, 4.82],
)


def test_peaks_at_a_rounding_half(spark, tmp_path):
    rows = [(u, k, v) for u, values in enumerate(WINDOWS) for k, v in enumerate(values)]
    events = pd.DataFrame([(n, pd.Timestamp(2024, 1, 1, 0, 0, k), u, "error" if k == 10 else "view", v) for n, (u, k, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"})
    got, want = both(spark, tmp_path, "peak_halfdecay", events=events)
    assert got == want and len(got[1]) == 3


def test_baselines_are_summed_in_order_of_offset(spark):
    rows = [(f"t{i}", k - 10, v, v > 5) for i, values in enumerate(WINDOWS) for k, v in enumerate(values)]
    want = {}
    for i, values in enumerate(WINDOWS):
        good = [v for v in values[:9] if v > 5]
        total = 0.0
        for v in good:
            total += v
        want[f"t{i}"] = total / len(good)
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        df = spark.createDataFrame(order, "trial_id string, offset int, value double, valid boolean").coalesce(1)
        got = windows.with_baseline(df, ["trial_id"]).select("trial_id", "f0").distinct().collect()
        assert {r.trial_id: r.f0 for r in got} == want and len(got) == 3


def test_edges_of_one_row_id_keep_the_first_labels(spark, tmp_path):
    """Labels c0, c40 and c80 are one neuron, c1 and c41 another; orders 1 and 2 have lines of one number several times."""
    lines = [(1, 40, 1, 3), (1, 0, 41, 3), (1, 80, 1, 3), (2, 80, 41, 1), (2, 0, 1, 1), (2, 40, 41, 1), (None, 0, 1, 2), (None, 40, 41, 2), (9, 0, 41, 3)]
    lines += [(100 + i, 9, 9, 1) for i in range(500)]  # of labels that no part has: more lines than labels, as in the tables
    lineitem = pd.DataFrame(lines, columns=["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"]).astype("Int64").assign(l_quantity=2.0, l_returnflag="R")
    got, want = both(spark, tmp_path, "typed_edges", lineitem=lineitem, part=pd.DataFrame({"p_partkey": [0, 1, 40, 41, 80]}))
    assert got == want and {("c40", "c1"), ("c80", "c41")} <= {(r[want[0].index("raw_pre")], r[want[0].index("raw_post")]) for r in want[1]}
