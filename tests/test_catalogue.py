"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from telltale.plans import catalogue, network  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(table: list[dict]) -> list:
    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in table), key=str)


def close(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert not [k for k in kinds.items() if "HUGEINT" in k[1] or "DECIMAL" in k[1]], "types that Spark's result doesn't have"
    for c, t in df.dtypes:
        assert {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}.get(t) == kinds[c], (c, t, kinds[c])
    ours, theirs = rows([r.asDict() for r in df.collect()]), rows([dict(zip(names, r, strict=True)) for r in cur.fetchall()])
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(close, a, b))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_healthy_block_without_a_leak_is_as_its_sql_says(spark, tmp_path):
    spark.sql("SELECT 'A' AS l_returnflag, 'F' AS l_linestatus, 10.0D AS l_quantity, CAST(timestamp'1995-01-01 05:00:00' + make_dt_interval(CAST(id AS INT)) AS timestamp_ntz) AS l_shipdate FROM range(100)").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = c.execute(catalogue.SQL["healthy_block"]).fetchall()
    assert theirs == [(None, 0, 20)]
    assert [tuple(r) for r in catalogue.QUERIES["healthy_block"](spark, str(tmp_path)).collect()] == theirs
    # the second stage's own cut: a table without a leak is one healthy block
    flags = catalogue.flagged(spark, str(tmp_path))
    assert tuple(network.packets.healthy_block(flags, flags["flag"] == 1).first()) == (None, 100, 60)
