"""Every registered query with an oracle equals DuckDB on the same parquet (sf0.001)."""
import math

import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL, duck_views

SQLS = entry.oracle_sql()
QUERIES = entry.queries()
NAMES = sorted(SQLS)


def _rows(pdf):
    pdf = pdf.astype(object).where(pd.notna(pdf), None)
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(QUERIES)
    assert len(SQLS) >= 60


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", NAMES)
def test_oracle_equal(spark, duck, name):
    duck_views(duck, SF_SMALL)
    sdf = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(SQLS[name])
    spark_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got = sdf.toPandas()
    exp = rel.df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)
