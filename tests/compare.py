"""Order-free comparison of a Spark result with its check SQL."""

import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, float) and not math.isinf(value) and value == int(value):
        return (1, str(int(value)))
    return (1, str(value))


def assert_same(df, duck, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert len(got) == len(wanted)
    known = set(wanted)
    assert [x for x in got if x not in known][:5] == []
    assert got == wanted
