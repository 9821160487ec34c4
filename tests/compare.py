"""A query's rows against its SQL's."""

import os

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.12g}")
    return value


def assert_same(df, con, sql: str) -> None:
    want = con.execute(sql).df()
    names = sorted(want.columns)
    assert names == sorted(df.columns)
    got = sorted(map(str, [tuple(plain(r[n]) for n in names) for r in df.collect()]))
    cells = want[names].astype(object).where(want[names].notna(), None)
    expected = []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for row in cells.itertuples(index=False, name=None):
        out = []
        for n, v in zip(names, row, strict=True):
            if v is not None and kinds[n] in ("int", "bigint", "smallint"):
                v = int(v)
            elif v is not None and kinds[n] == "double":
                v = plain(float(v))
            elif v is not None and kinds[n] == "boolean":
                v = bool(v)
            out.append(v)
        expected.append(str(tuple(out)))
    assert got == sorted(expected)
