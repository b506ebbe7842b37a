"""Event-sequence patterns and row patterns on small traces."""

from eddyline.operators import pattern as P
from eddyline.operators import rowpattern as M

S = 1_000_000


def events(*specs):
    out = []
    for i, s in enumerate(specs):
        kind, t = s.split("@")
        out.append({"_ts": int(float(t) * S), "_seq": i, "kind": kind[0], "id": kind})
    return out


def is_(kind):
    return lambda e, m: e["kind"] == kind


A, B, C = (P.atom(k.lower(), is_(k)) for k in "ABC")
LOG = events("A1@1", "B1@2", "C1@3", "B2@4", "A2@5", "D1@6", "B3@7", "D2@8")


def ids(matches):
    return [{k: v["id"] if isinstance(v, dict) else [x["id"] for x in v] for k, v in m.items()} for _, m in matches]


def test_without_every_a_pattern_fires_once():
    assert ids(P.run_pattern(B, LOG)) == [{"b": "B1"}]
    assert ids(P.run_pattern(B.every(), LOG)) == [{"b": "B1"}, {"b": "B2"}, {"b": "B3"}]


def test_nested_every_multiplies():
    for depth, counts in ((2, [1, 2, 4]), (3, [1, 3, 9]), (4, [1, 4, 16])):
        node = B
        for _ in range(depth):
            node = node.every()
        found = [m["b"] for m in ids(P.run_pattern(node, LOG))]
        assert [found.count(b) for b in ("B1", "B2", "B3")] == counts


def test_followed_by_and_every():
    assert ids(P.run_pattern(A.then(B), LOG)) == [{"a": "A1", "b": "B1"}]
    assert ids(P.run_pattern(A.then(B).every(), LOG)) == [{"a": "A1", "b": "B1"}, {"a": "A2", "b": "B3"}]
    assert ids(P.run_pattern(A.every().then(B.every()), LOG)) == [{"a": "A1", "b": "B1"}, {"a": "A1", "b": "B2"}, {"a": "A1", "b": "B3"}, {"a": "A2", "b": "B3"}]


def test_followed_by_same_key():
    log = [{"_ts": i, "_seq": i, "k": k, "v": v} for i, (k, v) in enumerate([("E1", 1), ("E2", 10), ("E1", 2)])]
    node = P.atom("a").every().then(P.atom("b", lambda e, m: e["k"] == m["a"]["k"]))
    assert [(m["a"]["k"], m["a"]["v"], m["b"]["v"]) for _, m in P.run_pattern(node, log)] == [("E1", 1, 2)]


def test_within_excludes_the_end():
    assert ids(P.run_pattern(A.then(B.within(int(1.01 * S))), LOG)) == [{"a": "A1", "b": "B1"}]
    assert ids(P.run_pattern(A.then(B.within(S)), LOG)) == []


def test_and_or_either_order():
    assert ids(P.run_pattern(B.and_(A), LOG)) == [{"a": "A1", "b": "B1"}]
    assert ids(P.run_pattern(C.or_(B), LOG)) == [{"b": "B1"}]


def test_absence_with_a_timer():
    node = A.every().then(P.Timer(3 * S).and_(B.not_()))
    log = events("A1@1", "B1@2", "A2@5", "D@12")
    assert [(at, m["a"]["id"]) for at, m in P.run_pattern(node, log)] == [(8 * S, "A2")]


def test_timer_of_zero_fires_at_once():
    assert [at for at, _ in P.run_pattern(A.then(P.Timer(0)), LOG)] == [S]


def test_until_collects():
    assert ids(P.run_pattern(B.until(P.atom("d", is_("D"))), LOG)) == [{"b": ["B1", "B2"], "d": "D1"}]
    assert ids(P.run_pattern(B.until(None, 2, 2), LOG)) == [{"b": ["B1", "B2"]}]


def test_while_guard_kills_its_branch():
    node = B.every().while_(lambda m: m["b"]["id"] != "B2")
    assert ids(P.run_pattern(node, LOG)) == [{"b": "B1"}]


def test_every_distinct_and_limit_of_states():
    node = P.atom("a").every_distinct(lambda m: m["a"]["kind"])
    assert [m["a"] for m in ids(P.run_pattern(node, LOG))] == ["A1", "B1", "C1", "D1"]
    run = P.Run(A.every().then(C), most_states=3)
    run.begin(0)
    for e in events("A1@1", "A2@2", "A3@3"):
        run.send(e)
    assert run.refused > 0 and run.states <= 3


def test_consume_takes_the_event():
    high, low = P.atom("a", is_("B"), consume=2), P.atom("b", is_("B"), consume=1)
    assert ids(P.run_pattern(high.or_(low), LOG)) == [{"a": "B1"}]


def rows(*values):
    return [{"_ts": i * S, "id": f"E{i + 1}", "v": v} for i, v in enumerate(values)]


def test_rising_pairs_do_not_overlap():
    define = {"B": lambda r, t, prev: r["v"] > t["A"][0]["v"]}
    got = M.recognise(rows(5, 3, 6, 4, 6, 10, 9, 4), M.sequence(M.var("A"), M.var("B")), define)
    assert [(t["A"][0]["id"], t["B"][0]["id"]) for _, t in got] == [("E2", "E3"), ("E4", "E5")]


def test_repetition_and_greed():
    over = {"A": lambda r, t, p: r["v"] >= 100, "B": lambda r, t, p: r["v"] >= 102}
    temps = rows(99, 100, 100, 101, 102)
    got = M.recognise(temps, M.var("A").repeat(2, 2), over)
    assert [[x["id"] for x in t["A"]] for _, t in got] == [["E2", "E3"], ["E4", "E5"]]
    got = M.recognise(temps, M.sequence(M.var("A").repeat(2), M.var("B")), over)
    assert [([x["id"] for x in t["A"]], t["B"][0]["id"]) for _, t in got] == [(["E2", "E3", "E4"], "E5")]
    lazy = M.recognise(temps, M.sequence(M.var("A").one_or_more().reluctant(), M.var("X")), over)
    assert [len(t["A"]) for _, t in lazy] == [1, 1]


def test_permute_alternation_optional_and_interval():
    kinds = {k: (lambda k: lambda r, t, p: r["v"] == k)(k) for k in "ABC"}
    assert len(M.recognise(rows("B", "A"), M.permute(M.var("A"), M.var("B")), kinds)) == 1
    assert len(M.recognise(rows("C", "A"), M.alternation(M.var("A"), M.var("C")), kinds)) == 2
    got = M.recognise(rows("A", "C"), M.sequence(M.var("A"), M.var("B").optional(), M.var("C")), kinds)
    assert len(got) == 1
    timed = [{"_ts": t * S, "v": v} for t, v in ((1, "A"), (13, "A"), (15, "B"))]
    got = M.recognise(timed, M.sequence(M.var("A"), M.var("B").zero_or_more()), kinds, interval=10 * S)
    assert [(at // S, len(t.get("B", []))) for at, t in got] == [(11, 0), (23, 1)]


def test_all_matches_and_long_runs():
    define = {"A": lambda r, t, p: True}
    assert len(M.recognise(rows(1, 2, 3), M.var("A").one_or_more(), define, all_matches=True, skip="to_next_row")) == 6
    assert len(M.recognise(rows(*range(5000)), M.var("A").one_or_more(), define)[0][1]["A"]) == 5000
