"""Every query that SQL can express gives the same rows, names and types in DuckDB."""

from __future__ import annotations

import math

import pytest

from faintlabel.plans.oracle import ORACLE
from faintlabel.plans.queries import QUERIES

SPARK_KIND = {"bigint": "int64", "int": "int32", "double": "float64", "string": "text"}
DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "text"}


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return "null" if v is None else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    kinds = dict(zip(names, (str(c[1]) for c in rel.description)))
    assert {c: SPARK_KIND.get(t, t) for c, t in df.dtypes} == {c: DUCK_KIND.get(kinds[c], kinds[c]) for c in names}
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    a, b = canonical(tuple(r) for r in got), canonical(want)
    assert len(a) == len(b)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, f"{len(diff)} of {len(a)} rows differ, first {diff[0]}"


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
