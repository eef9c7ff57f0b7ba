"""Every registered query outside the corpus operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry  # registers all catalogues
from loomspark.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tiny}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool, str)) else round(float(v), 6) + 0.0 if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    names = found.columns
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_reward_model_reads_whole_texts(spark, tiny, duck):
    import re
    from collections import Counter
    from hashlib import sha256

    rows = duck.sql("SELECT text, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL ORDER BY doc_id").fetchall()
    weights, bias = [0.0] * 8192, 0.0
    counted = [(Counter(int(sha256(t.encode()).hexdigest()[:8], 16) % 8192 for t in re.findall(r"[a-z_][a-z0-9_]+", (text or "").lower())), y) for text, y in rows]
    for _ in range(3):
        for counts, y in counted:
            z = bias + sum(weights[b] * v for b, v in counts.items())
            gradient = (1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))) - y
            bias -= 0.08 * gradient
            for b, v in counts.items():
                weights[b] -= 0.08 * (gradient * v + 1e-6 * weights[b])
    found = {r.bucket: r.weight for r in QUERIES["prm_train_exact"](spark, tiny).collect()}
    assert found.pop(-1) == pytest.approx(bias)
    assert found == pytest.approx({b: w for b, w in enumerate(weights) if w})
