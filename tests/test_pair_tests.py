"""Rank sums of all pairs of groups against those of each pair alone."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import stats


def test_pairs_of_groups(spark):
    r = np.random.default_rng(8)
    obs = spark.createDataFrame([(c, int(c % 4)) for c in range(60)], "cell_id bigint, donor int")
    rows = [(c, g, float(r.integers(1, 5))) for g in range(12) for c in range(60) if r.random() < 0.06 * g and (g > 3 or c % 4 == 1)]
    expr = spark.createDataFrame(rows, "cell_id bigint, gene bigint, count double")
    for least in (0.01, 0.3):
        got = stats.differential_pairs(expr, obs, "donor", min_fraction=least)
        got = {(x.rep1, x.rep2, x.gene): (x.z, x.p, x.fdr, x.log2fc) for x in got.collect()}
        want = {}
        for a in range(4):
            for b in range(a + 1, 4):
                lab = obs.where(f"donor in ({a}, {b})").select("cell_id", F.when(F.col("donor") == a, 1).otherwise(2).alias("grp"))
                want |= {(a, b, x.gene): (x.z, x.p, x.fdr, x.log2fc) for x in stats.differential(expr, lab, min_fraction=least).collect()}
        assert got.keys() == want.keys() and got
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
