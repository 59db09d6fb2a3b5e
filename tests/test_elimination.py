"""Block elimination against the dense solve of all pairs together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.models import elimination as E
from trialforge.models import kernels as K


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(8)
    m, k, rows = 4, 3, []
    for a in range(8):
        for p in range(11):
            if rng.random() < 0.3 or p == 10 and a != 2:  # the last pair is one animal's alone
                continue
            for _ in range(6):
                x, z = rng.normal(size=m) * (1 + p), rng.normal(size=k)
                rows.append((f"a{a}", f"t{p % 3}", f"r{p}", x.tolist(), z.tolist(), float(x @ np.arange(m) + z.sum() + rng.normal())))
    moments = K.moments(spark.createDataFrame(rows, "animal string, target string, responder string, x array<double>, z array<double>, v double"), ["animal", "target", "responder"], m, k)
    folds = spark.createDataFrame([(o, "test" if a % 4 == o else "train", None if a % 4 == o else a % 3, f"a{a}") for o in range(2) for a in range(8)], "outer int, role string, inner int, animal string")
    return moments, folds, m, k


def test_equals_the_dense_solve(spark, problem):
    moments, folds, m, k = problem
    pair, ridges = ["target", "responder"], (0.01, 10.0)
    got = E.fits(moments, folds, pair, m, k, ("null", "independent"), ridges).toPandas()
    table, roles = moments.toPandas(), folds.toPandas()
    seen = 0
    for o in range(2):
        train = roles[(roles["outer"] == o) & (roles["role"] == "train")]
        for split in (E.REFIT, *sorted(train["inner"].unique())):
            s = K.stack(table[table["animal"].isin(train[train["inner"] != split]["animal"])], pair, m, k)
            for family, r in (("null", 0.0), *(("independent", x) for x in ridges)):
                f = K.FAMILIES[family](s, r)
                part = got[(got["outer"] == o) & (got["split"] == split) & (got["family"] == family) & (got["ridge"] == r)]
                shared, own = part[part["responder"].isna()], part[part["responder"].notna()]
                assert len(shared) == 1 and np.allclose(shared["b"].iloc[0], f.b, rtol=1e-8)
                if family == "independent":
                    by = {(x.target, x.responder): x.c for x in own.itertuples()}
                    assert set(by) == set(s.pairs) and all(np.allclose(by[q], c, rtol=1e-7, atol=1e-10) for q, c in zip(s.pairs, f.c))
                seen += 1
    assert seen == 2 * 4 * 3


def test_pairs_of_one_fold_and_empty_tables(spark, problem):
    moments, folds, m, k = problem
    sums = E.split_moments(moments, folds, ["target", "responder"])
    lonely = {(r["outer"], r["split"]) for r in sums.filter("responder = 'r10'").collect()}
    assert lonely == {(o, s) for o in range(2) for s in (-1, 0, 1, 2) if o != 2 % 4 and s != 2 % 3}
    none = E.fits(moments.filter(F.lit(False)), folds, ["target", "responder"], m, k, ("null", "independent"))
    assert none.count() == 0
