"""Order-free comparison of a Spark result with SQL over the same tables."""

import math


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(df, duck, sql):
    names = sorted(df.columns)
    got = duck.execute(sql)
    theirs = [c[0] for c in got.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=key)
    want = sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=key)
    assert mine == want
    return mine
