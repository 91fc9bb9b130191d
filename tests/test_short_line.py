"""Surveys whose last inline is short: the queries equal their SQL whatever the number of rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

from .test_queries import canonical


@pytest.fixture(scope="module")
def short_dir(spark, data_dir, tmp_path_factory):
    """498 embeddings: 19 inlines of 25 traces and one of 23, 9 rows of 50 and one of 48."""
    out = str(tmp_path_factory.mktemp("short"))
    spark.read.parquet(f"{data_dir}/embeddings.parquet").where("vec_id < 498").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["create_headers", "create_volume", "ignore_header", "textual_lines", "region_outline_xy", "xline_slice"])
def test_short_last_line_equals_sql(spark, data_dir, short_dir, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{short_dir}/embeddings.parquet/*.parquet'")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data_dir}/lineitem.parquet'")
    want = duck.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, short_dir)
    columns = [d[0] for d in want.description]
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), columns)
