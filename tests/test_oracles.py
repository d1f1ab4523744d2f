"""Every registered query against its SQL on the smallest tables (set ORACLE_ALL=1 for the slow ones too)."""

import os

import duckdb
import pandas as pd
import pytest

from strandlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries of the full cohort take seconds each; these stand for them.
COHORT = {"population_database", "bridges_description", "denovo_cut", "max_other_family", "bridge_lookup", "coverage_at", "dupe_marking", "segments", "pedigree_calls", "bad_bins_mad", "mums_to_sam", "pop_round_trip"}
SLOW_MODULES = ("bridge_queries", "cn_queries")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows(df):
    df = df.astype({c: "datetime64[us]" for c in df.columns if df[c].dtype.kind == "M"})
    df = df.astype({c: float for c in df.columns if str(df[c].dtype) in ("Int64", "Int32") or df[c].dtype.kind in "iu"})
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def chosen():
    for name in registry.ORACLES:
        module = registry.MODULES[name]
        if os.environ.get("ORACLE_ALL") or name in COHORT or not module.endswith(SLOW_MODULES):
            yield name


@pytest.mark.parametrize("name", list(chosen()))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["lowess", "hmm", "equal_mass_bins", "tandem_repeats", "state_calls", "unequal_counts"])
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
