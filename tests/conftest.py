import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from talkweave.session import session, ship

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with DuckDB's rows for the SQL: columns by name, rows in any order, floats to six places."""
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(SF).glob("*.parquet")):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def check(df, sql):
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
        assert got == want

    return check
