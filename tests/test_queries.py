"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from wicker.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Trained by pyspark.ml or long: the driver runs them; here they would take most of the time.
SLOW = {"ranked_learned", "concatenated", "with_residual", "ridge_map", "cluster_nmi", "popularity_alignment", "svd_vectors", "walk_vectors", "noise_control"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.5g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got) > 0
        assert not got.isna().all(axis=None)
