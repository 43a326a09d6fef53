"""Sets a registered query against its DuckDB equivalent on the same Parquet tables."""

from pathlib import Path

SF_DIR = "/root/testdata/sf0.001"


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return repr(value)


def assert_same(spark, query, sql, sf_dir=SF_DIR):
    import duckdb

    with duckdb.connect() as con:
        for path in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        expected = sorted(_plain([r[names.index(n)] for n in sorted(names)]) for r in want.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(_plain([r[n] for n in sorted(names)]) for r in df.collect()) == expected
