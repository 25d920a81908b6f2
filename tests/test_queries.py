"""Every registered query beside its DuckDB twin on the smallest tables; those without one must have rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandframe.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        if "restored" in columns:
            assert {r[columns.index("restored")] for r in rows} == {"True"}
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in got.fetchall())


def halves(n: int) -> np.ndarray:
    """Floats whose products with 1000 are halves in floats, but not in doubles."""
    x = ((np.arange(-400 * n, 400 * n) + 0.5) / 1000).astype(np.float32)
    return x[(x * np.float32(1000) % 1 == 0.5) & (x.astype(float) * 1000 % 1 != 0.5)][:n]


def equal_to_sql(spark, name, at, tables):
    """The query and its SQL over tables of our own."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{at}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(at))
    got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert len(got) and sorted(map(tuple, df.collect())) == sorted(got)


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_lifting_split_rounds_as_sql(spark, tmp_path, kind):
    x = halves(640).reshape(10, 64).tolist()
    equal_to_sql(spark, "lifting_split", tmp_path, {"embeddings": pa.table({"vec_id": range(10), "embedding": pa.array(x, pa.list_(kind))})})


def test_volume_delta_is_as_sql(spark, tmp_path):
    """Rounding, and slabs of ids that are negative or too large for doubles."""
    ids = [*range(-70, 70), *(2**60 + k for k in range(-3, 3))]
    x = np.resize(halves(640), (len(ids), 8)).tolist()
    equal_to_sql(spark, "volume_delta", tmp_path, {"embeddings": pa.table({"vec_id": ids, "embedding": pa.array(x, pa.list_(pa.float32()))})})
