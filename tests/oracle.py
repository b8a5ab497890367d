"""Compare a Spark result with a DuckDB result: same columns, same rows in any order."""

import math


def _plain(v):
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(frame, duck, sql):
    relation = duck.execute(sql)
    names = [d[0] for d in relation.description]
    expected = relation.fetchall()
    assert sorted(frame.columns) == sorted(names)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(names, expected)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
