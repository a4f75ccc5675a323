"""Every query of call resolution, control flow, modules, reading paths, detection and views against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from codeloom.plans import registry, resolution

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(name for name, f in registry.QUERIES.items() if name in registry.ORACLE_SQL and f.__closure__[0].cell_contents.__module__ == resolution.__name__)


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([int(r[k]) if isinstance(r[k], float) and r[k] == int(r[k]) else r[k] for k in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    told = con.sql(registry.ORACLE_SQL[name])
    made = registry.QUERIES[name](spark, SF)
    assert sorted(made.columns) == sorted(told.columns)
    want = plain(told.fetchall(), told.columns)
    assert want and plain([tuple(r) for r in made.collect()], made.columns) == want
