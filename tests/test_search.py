"""Tree search against a plain loop over each case."""

import random

from loomspark.operators import search

SCHEMA = "case int, round int, node int, parent int, code string, node_score double, score double, exec_time double, all_passed boolean"


def plain(rows, rounds, width, patience):
    outcomes, paths = {}, set()
    for case in {r[0] for r in rows}:
        own = {(r[1], r[2]): r for r in rows if r[0] == case}
        beam, best, stale, end, ran = None, None, 0, None, 0
        for k in range(1, rounds + 1):
            live = [r for r in own.values() if r[1] == k and (r[3] is None if beam is None else r[3] in beam)]
            if not live:
                break
            ran = k
            live.sort(key=lambda r: (-r[5], -r[6], r[7], r[2]))
            better = best is None or live[0][5] > best[5]
            best, stale = (live[0], 0) if better else (best, stale + 1)
            end = next((r for r in live if r[8]), None)
            if end or (patience > 0 and stale >= patience):
                break
            beam, codes = set(), set()
            for r in live:
                if len(beam) < width and (r[4] or "").strip() and r[4] not in codes:
                    codes.add(r[4])
                    beam.add(r[2])
            if not beam:
                break
        if not ran:
            continue
        won = end or best
        outcomes[case] = ("passed" if end else "failed", won[1], won[2], ran)
        while won is not None:
            paths.add((case, won[1], won[2]))
            won = own.get((won[1] - 1, won[3]))
    return outcomes, paths


def test_equals_the_plain_loop(spark):
    r = random.Random(4)
    rows = []
    for case in range(30):
        for k in range(1, 5):
            for node in range(5):
                parent = r.randrange(5) if k > 1 else None
                rows.append((case, k, node, parent, r.choice(["a", "b", "c", "d", " ", None]), r.choice([0.1, 0.5, 0.5, 0.9]), float(r.randrange(3)), r.choice([0.1, 0.2]), r.random() < 0.05 or None))
    for width, patience in ((2, 0), (3, 1)):
        outcome, path = search.tree_search(spark.createDataFrame(rows, SCHEMA), 4, width, patience)
        want, steps = plain(rows, 4, width, patience)
        assert {x.case: (x.status, x.round, x.node, x.n_rounds) for x in outcome.collect()} == want
        assert {tuple(x) for x in path.collect()} == steps and path.count() == len(steps)


def test_nothing_to_search(spark):
    outcome, path = search.tree_search(spark.createDataFrame([(1, 2, 1, 7, "x", 1.0, 1.0, 1.0, True)], SCHEMA), 3)
    assert outcome.count() == 0 and path.count() == 0
