"""Sale enrichment against a plain simulation of the batches, and against its SQL."""

import math
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from loomspark.llm import sale_enrichment as op

EPOCH, START = datetime(1970, 1, 1), datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, kind string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
COLUMNS = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]


def least(x):
    return -math.inf if x is None else x


def simulate(sales, changes, batches, days):
    """The contract, batch by batch, on lists."""
    number = lambda t, lag=0: max(0, min(batches - 1, ((t - EPOCH).days + lag - 19723) * batches // days)) if t else 0
    crc = lambda i: zlib.crc32(str(i).encode()) % 4 if i is not None else 0
    sold = [[s for s in sales if number(s[5]) == b] for b in range(batches)]
    came = [[c for c in set(changes) if c[4] is not None and number(c[4], crc(c[0])) == b] for b in range(batches)]
    out, waiting, held = [], [], {}
    order = lambda v: (v[4], least(v[2]), least(v[0]))
    for b in range(batches + 1):
        mark = lambda rows, at: max((r[at] for part in rows[:b] for r in part if r[at]), default=None)
        tops = [mark(sold, 4), mark(came, 4)]
        h = None if None in tops else min(tops) - timedelta(hours=36)
        for c in came[b] if b < batches else []:
            if tops[1] and c[4] < tops[1] - timedelta(hours=36):
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        waiting += sold[b] if b < batches else []
        due = [s for s in waiting if b == batches or s[4] is None or (h and s[4] < h)]
        waiting = [s for s in waiting if not (s[4] is None or (h and s[4] < h))]
        for s in due:
            mine = held.get(s[1], [])
            fit = max((v for v in mine if s[4] and v[4] <= s[4]), key=order, default=None)
            cents = math.floor(100 * fit[8] + 0.5) if fit and fit[8] is not None and math.isfinite(fit[8]) else None
            out.append(("sale", s[0], b, len(mine), fit and fit[0], cents, fit and fit[3]))
        for client, mine in held.items():
            old = sorted((v for v in mine if h and v[4] <= h), key=order)
            held[client] = old[-1:] + [v for v in mine if not (h and v[4] <= h)]
    return Counter(out)


def shop(seed, n, days):
    """Random rows: late ones, ties, repeated rows, nulls, a client with half of all."""
    r = random.Random(seed)
    at = lambda: START + timedelta(hours=r.choice([r.randrange(days * 24), r.randrange(40), 24 * r.randrange(days)]))
    client = lambda: r.choice([7, 7, 7, 1, 2, 3, None])
    sales = []
    for i in range(n):
        t = at()
        sales.append((r.choice([i, i // 2, None]) if i % 9 == 0 else i, client(), "x", 1.0, r.choice([t, t, t, t, None]), r.choice([t + timedelta(hours=r.choice([0, 1, 30, 90])), t, t, None if i % 5 == 0 else t]), 1, "k"))
    changes = [(r.choice([i, None]) if i % 11 == 0 else i, client(), r.choice([0, 1, 2, None]), r.choice(["I", "U", "D", None]), r.choice([at()] * 9 + [None]), "s", None, "c", r.choice([1.005, -2.5, None, float("nan"), 1234.56, float("inf")])) for i in range(n)]
    # a NaN differs from itself in the plain version's set
    changes = [(*c[:8], None if c[8] is not None and math.isnan(c[8]) else c[8]) for c in changes]
    return sales + sales[:5], changes + changes[:9]


def run(spark, sales, changes, **kw):
    df = op.enrich_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), **kw)
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "rows_to_split"), [(1, 1), (2, 10_000)])
def test_equals_the_simulation(spark, seed, rows_to_split):
    sales, changes = shop(seed, 260, 12)
    assert run(spark, sales, changes, batches=4, days=12, least=rows_to_split) == simulate(sales, changes, 4, 12)


def test_batches_without_rows_move_on(spark):
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    sales = [(1, 7, "x", 1.0, day(0), day(0), 1, "k"), (2, 7, "x", 1.0, day(3), day(3), 1, "k"), (3, 8, "x", 1.0, day(3, 1), day(3, 1), 1, "k")]
    changes = [(10, 7, 0, "I", day(0), "s", None, "c", 1.0), (11, 7, 1, "U", day(2, 23), "s", None, "c", 2.0)]
    assert run(spark, sales, changes, batches=3, days=12) == simulate(sales, changes, 3, 12)


def test_a_start_opens_one_store_a_partition(spark, monkeypatch):
    """Each start has but one stateful stage."""
    seen, run_query = [], op.Feed.run

    def watched(feed):
        out = run_query(feed)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{feed.ws.root}/checkpoint/state")
        seen.extend(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
        return out

    monkeypatch.setattr(op.Feed, "run", watched)
    sales, changes = shop(4, 60, 12)
    assert run(spark, sales, changes, batches=1, days=12) == simulate(sales, changes, 1, 12)
    assert seen == ["0"]


def test_empty_tables(spark):
    assert run(spark, [], [], batches=1) == Counter()


def test_sql_equals_the_simulation(tmp_path):
    sales, changes = shop(5, 400, 152)
    con = duckdb.connect()
    con.execute("CREATE TABLE sales (sale_id BIGINT, client_id BIGINT, status TEXT, total DOUBLE, sold_at TIMESTAMP, arrived_at TIMESTAMP, priority INT, kind TEXT)")
    con.execute("CREATE TABLE client_changes (change_id BIGINT, client_id BIGINT, seq BIGINT, op TEXT, valid_at TIMESTAMP, source TEXT, segment TEXT, city TEXT, balance DOUBLE)")
    con.executemany("INSERT INTO sales VALUES (?, ?, ?, ?, ?, ?, ?, ?)", sales)
    con.executemany("INSERT INTO client_changes VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", changes)
    got = Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({op.OP11_SQL})").fetchall())
    assert got == simulate(sales, changes, 10, 152)
