from collections import defaultdict

from loomspark.llm.chat_format import collapse_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_turns string"


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x, _ in rows:
        convs[c].add((t, r, x))
    low = lambda v: (v is not None, v)
    said = {c: tuple((r, x) for t, r, x in sorted(s, key=lambda k: tuple(map(low, k)))) for c, s in convs.items()}
    kept = {}
    for c, s in said.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            kept.setdefault(s, []).append(c)
    return {(min((c for c in cs if c is not None), default=None), len(s), len(cs)) for s, cs in kept.items()}


def test_prefixes_collapse(spark):
    def conv(i, *texts):
        return [(i, t, "user" if t % 2 == 0 else "assistant", x, "z") for t, x in enumerate(texts)]

    rows = conv(1, "hi") + conv(2, "hi", "yo") + conv(3, "hi", "yo", "ok") + conv(4, "hi", "yo", "no") + conv(5, "hi", "yo", "ok") + conv(6, "other") + conv(6, "other")
    rows += [(7, 0, None, None, None), (8, 0, None, None, None), (8, 1, "user", "", None), (None, None, None, None, None), (9, 0, "b", "x", None), (9, 0, "a", "y", None)]
    rows += [(20 + i, 0, "user", "common", None) for i in range(300)] + [(400, 0, "user", "common", None), (400, 1, "assistant", "end", None)]
    out = collapse_conversations(spark.createDataFrame(rows, SCHEMA))
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in out.collect()} == brute(rows)
    text = {r.conv_id: r.rendered for r in out.collect()}
    assert text[3] == "### user\nhi\n\n### assistant\nyo\n\n### user\nok"
    assert collapse_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
