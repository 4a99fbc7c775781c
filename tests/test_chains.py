"""Chains of statuses against plain searches, dense exponentials and plain recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import states as sa
from cladeframe.operators import chains

N = 6
ANNOTATED = f"barcode int, node_id string, parent_id string, state {sa.STATE}"


def sg(start, length, nd, lo, hi, xd):
    return (start, length, nd, lo, hi, xd, "")


def wc(lo, hi):
    return (None, None, lo, lo, hi, hi, None)


WIDE, INNER, SIDE, LONG = sg(10, 90, 0, 0, 3, 3), sg(60, 4, 2, 2, 2, 2), sg(130, 5, 4, 4, 4, 4), sg(140, 30, 4, 5, 5, 5)
TREE = [  # node, parent, states of two barcodes
    ("r", None, [], []),
    ("a", "r", [wc(1, 2), SIDE], [wc(0, 1)]),
    ("b", "r", [], [INNER]),
    ("x", "a", [WIDE, SIDE], [sg(19, 3, 0, 0, 0, 0), SIDE]),
    ("y", "a", [INNER, SIDE], [sg(46, 3, 1, 1, 1, 1)]),
    ("z", "a", [INNER, SIDE], [sg(46, 3, 1, 1, 1, 1)]),
    ("u", "b", [], [INNER, SIDE, LONG]),
    ("v", "b", [WIDE, LONG], [INNER]),
]
LEVEL = {"r": 0, "a": 1, "b": 1, "x": 2, "y": 2, "z": 2, "u": 2, "v": 2}
PARENT = {n: p for n, p, *_ in TREE}
STATE = {(b, row[0]): row[2 + b] for row in TREE for b in (0, 1)}
RATES = ([0.3, 0.5, 0.2, 0.7, 0.4, 0.6], 0.3, 0.05, 0.07)


def tract(x):
    return x[2:6]


def is_single(x):
    return x[0] is not None


def mask(tracts):
    return sum({1 << k for t in tracts for k in range(t[0], t[3] + 1)})


def possible(state, tracts):
    own = [tract(x) for x in state if is_single(x)]
    for k, t in enumerate(tracts):
        inner = any((lo := x[3] + is_single(x)) <= (hi := x[4] - is_single(x)) and lo <= t[0] and t[3] <= hi for x in state)
        if t not in own and not inner:
            return False
        if t in own:  # a long side on a target that a short side ends on needs its neighbour first
            if t[0] != t[1] and any(x[5] == x[4] == t[0] for x in state) and not (k and tracts[k - 1][3] == t[0]):
                return False
            if t[3] != t[2] and any(x[2] == x[3] == t[3] for x in state) and not (k + 1 < len(tracts) and tracts[k + 1][0] == t[3]):
                return False
    return True


def all_tracts():
    return {(max(lo - a, 0), lo, hi, min(hi + b, N - 1)) for lo in range(N) for hi in range(lo, N) for a in (0, 1) for b in (0, 1)}


def plain_close(state, starts, required, extra):
    """Every path of at most required + extra steps, walked one by one."""
    asked, steps = mask([tract(x) for x in state if is_single(x)]), required + extra
    if steps == 0:
        return {tuple(tract(x) for x in state if is_single(x))}
    reach = 0
    for x in state:
        reach |= mask([tract(x)])
    found = set()

    def walk(path, passed):
        now = path[-1]
        passed = passed or asked & ~mask(now) == 0
        if passed:
            found.update(path)
        if len(path) - 1 == steps:
            return
        for t in all_tracts():
            if all(reach & ~mask(now) & (1 << e) for e in (t[1], t[2])):
                new = tuple(sorted([y for y in now if not (y[1] > t[1] and t[3] > y[3])] + [t], key=lambda y: y[1]))
                if possible(state, new):
                    walk([*path, new], passed)

    for s in starts:
        walk([s], False)
    return found


def required(b, n):
    up = STATE[b, PARENT[n]]
    return len([x for x in STATE[b, n] if is_single(x) and x not in up])


def plain_tree(extra=1):
    have = {(b, "r"): {()} for b in (0, 1)}
    for level in (1, 2):
        for b in (0, 1):
            for p in {PARENT[n] for n, k in LEVEL.items() if k == level}:
                below = [n for n in LEVEL if PARENT[n] == p]
                first = [plain_close(STATE[b, n], have[b, p], required(b, n), extra) for n in below]
                shared = have[b, p].intersection(*first)
                for n in below:
                    have[b, n] = plain_close(STATE[b, n], shared, required(b, n), extra)
    return have


@pytest.fixture(scope="module")
def built(spark):
    rows = [(b, n, p, STATE[b, n]) for n, p, *_ in TREE for b in (0, 1)]
    annotated = spark.createDataFrame(rows, ANNOTATED)
    levels = spark.createDataFrame(list(LEVEL.items()), "node_id string, level int")
    return annotated, chains.tree_states(annotated, levels, N)


def test_states_close_by_along_a_tree(built):
    _, (states, nodes, own) = built
    of = {}
    for r in nodes.join(states, "chain").collect():
        of.setdefault((r.barcode, r.node_id), set()).add(tuple(tuple(t) for t in r.tracts))
        assert r.status == mask(r.tracts)
    assert of == plain_tree()
    assert all(r.extra == 1 and not r.over for r in own.collect())


def test_budget_lowers_extra_steps_and_says_so(spark):
    state = [WIDE, SIDE]
    edge = spark.createDataFrame([("k", state, 2, mask([tract(x) for x in state])), ("none", [], 0, 0)], f"chain string, state {sa.STATE}, required int, asked long")
    starts = edge.select("chain", F.array().cast(sa.TRACTS).alias("tracts"))
    wide = {tuple(map(tuple, r.tracts)) for r in chains.close_states(edge, starts, N)[0].where("chain = 'k'").collect()}
    assert wide == plain_close(state, {()}, 2, 1)
    found, report = chains.close_states(edge, starts, N, most=4)
    assert {tuple(map(tuple, r.tracts)) for r in found.where("chain = 'k'").collect()} == plain_close(state, {()}, 2, 0) != wide
    assert {(r.chain, r.extra, r.over) for r in report.collect()} == {("k", 0, False), ("none", 1, False)}
    found, report = chains.close_states(edge, starts, N, most=1)
    assert found.where("chain = 'k'").count() == len(plain_close(state, {()}, 2, 0))  # over the budget, but whole
    assert {(r.chain, r.over) for r in report.collect()} == {("k", True), ("none", False)}
    assert [c.count() for c in chains.close_states(edge.where("false"), starts.where("false"), N)] == [0, 0]


def hazard(t):
    lams, double, left, right = RATES
    base = lams[t[1]] if t[1] == t[2] else (lams[t[1]] + lams[t[2]]) * double
    return base * (left if t[0] != t[1] else 1) * (right if t[3] != t[2] else 1)


def dense(state, statuses):
    """Rates over the statuses, the sink last."""
    q = np.zeros((len(statuses) + 1,) * 2)
    singles = [x for x in state if is_single(x)]
    for i, s in enumerate(statuses):
        open_tracts = [t for t in all_tracts() if not s & (1 << t[1]) and not s & (1 << t[2])]
        for j, e in enumerate(statuses):
            ways = [t for t in open_tracts if s | mask([t]) == e]
            if not ways or e == s:
                continue
            special = [t for t in ways if t in [tract(x) for x in singles]]
            hit = [x for x in singles if (e & ~s) & (1 << x[3] | 1 << x[4])]
            q[i, j] = sum(map(hazard, special or ways)) * (1 if not hit else 1 / (2 + hit[0][1]) if len(hit) == 1 else 0)
        away = sum(map(hazard, open_tracts))
        q[i, i] = -away
        q[i, -1] = -q[i].sum()
    return q


def series(q, t):
    """exp(q t) by scaling and squaring of the plain series."""
    x, out, term = q * t / 2**12, np.eye(len(q)), np.eye(len(q))
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(12):
        out = out @ out
    return out


def trim(x):
    return F.lit(1.0) / (x["del_len"] + 2)


def test_rates_flow_into_a_sink(built):
    annotated, (states, _, own) = built
    rates = chains.rate_rows(states.where("chain != 'root'"), own, chains.Rates(*RATES), trim).collect()
    state_of = {r.chain: [tuple(x) for x in r.state] for r in own.collect()}
    statuses = {}
    for r in states.collect():
        statuses.setdefault(r.chain, set()).add(r.status)
    for chain, state in state_of.items():
        order = sorted(statuses[chain])
        got = np.zeros((len(order) + 1,) * 2)
        for r in rates:
            if r.chain == chain:
                got[order.index(r.status), len(order) if r.after is None else order.index(r.after)] += r.rate
        assert got == pytest.approx(dense(state, order), abs=1e-12) and np.abs(got.sum(axis=1)).max() < 1e-12


def test_action_of_the_exponential():
    rng = np.random.default_rng(1)
    for n, t in ((1, 0.4), (5, 0.0), (8, 1.3), (8, 60.0)):
        q = np.triu(rng.random((n, n)), 1)
        q -= np.diag(q.sum(axis=1) + rng.random(n))
        i, j = np.nonzero(q)
        v = rng.random(n)
        got, slope = chains.act(i, j, q[i, j], t, v)
        assert got == pytest.approx(series(q, t) @ v, rel=1e-9, abs=1e-25) and slope == pytest.approx(q @ got)


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_likelihood_by_plain_recursion(spark, built, weight):
    annotated, (states, nodes, own) = built
    length = {"r": 0.0, "a": 0.4, "b": 0.3, "x": 0.5, "y": 0.45, "z": 0.2, "u": 0.7, "v": 0.6}
    spine = {"r": 0.1, "a": 0.25, "b": 0.0}
    abundance = {"x": 3, "y": 1, "z": 2, "u": 1, "v": 5}
    rows = [(n, PARENT[n], LEVEL[n], length[n], spine.get(n, 0.0), abundance.get(n, 1)) for n in LEVEL]
    tree = spark.createDataFrame(rows, "node_id string, parent_id string, level int, length double, spine double, abundance int")
    leaves = annotated.where(F.col("node_id").isin(*abundance)).select("barcode", "node_id", sa.max_status(F.col("state")).alias("status"))
    rates = chains.rate_rows(states.where("chain != 'root'"), own, chains.Rates(*RATES), trim)
    got = {r.barcode: r.log_lik for r in chains.likelihood(tree, nodes, rates, leaves, chains.Rates(*RATES), weight).collect()}
    close = plain_tree()

    def away(s):
        return sum(hazard(t) for t in all_tracts() if not s & (1 << t[1]) and not s & (1 << t[2]))

    def at(b, n):
        order = sorted({mask(t) for t in close[b, n]})
        if n in abundance:
            seen = 0
            for x in STATE[b, n]:
                seen |= mask([tract(x)])
            return {s: float(s == seen) for s in order}
        out = {s: np.exp(-spine[n] * away(s)) for s in order}
        for c in (c for c in LEVEL if PARENT[c] == n):
            below = at(b, c)
            known = sorted(below)
            p = series(dense(STATE[b, c], known), length[c])[:-1, :-1] @ np.array([below[s] for s in known])
            times = 1 + weight * (abundance.get(c, 1) - 1)
            out = {s: v * p[known.index(s)] ** times if s in known else 0.0 for s, v in out.items()}
        return out

    for b in (0, 1):
        p = at(b, "r")[0]
        assert got[b] == pytest.approx(np.log(p), rel=1e-8) if p > 0 else got[b] is None
    assert any(at(b, "r")[0] > 0 for b in (0, 1))


def test_sisters_alike_but_for_positions_share_a_chain_if_told(spark):
    state = {"r": [], "x": [SIDE], "y": [sg(131, 5, 4, 4, 4, 4)], "z": [sg(130, 2, 4, 4, 4, 4)]}
    annotated = spark.createDataFrame([(0, n, None if n == "r" else "r", x) for n, x in state.items()], ANNOTATED)
    levels = spark.createDataFrame([(n, int(n != "r")) for n in state], "node_id string, level int")
    states, nodes, own = chains.tree_states(annotated, levels, N, told=lambda x: x["del_len"])
    name = {r.node_id: r.chain for r in nodes.collect()}
    assert name["x"] == name["y"] != name["z"] and own.count() == 2
    of = {}
    for r in nodes.join(states, "chain").collect():
        of.setdefault(r.node_id, set()).add(tuple(map(tuple, r.tracts)))
    assert of == {"r": {()}, **{n: plain_close(state[n], {()}, 1, 1) for n in "xyz"}}


def test_short_branches_reach_statuses_many_steps_away():
    i, j = np.array([0, 0, 1, 1, 2, 2, 3]), np.array([0, 1, 1, 2, 2, 3, 3])
    q = np.array([-1.0, 1, -1, 1, -1, 1, -1])
    got, _ = chains.act(i, j, q, 1e-7, np.array([0.0, 0, 0, 1]))
    assert got[0] == pytest.approx(1e-21 / 6, rel=1e-6)


def test_matrices_side_by_side():
    rng, rows, one = np.random.default_rng(2), [], []
    for n, t in ((1, 0.4), (5, 0.0), (8, 1.3), (8, 60.0), (3, 1e-6)):
        q = np.triu(rng.random((n, n)), 1)
        q -= np.diag(q.sum(axis=1) + rng.random(n))
        i, j = np.nonzero(q)
        rows.append((i, j, q[i, j], t, rng.random(n)))
        one.append(series(q, t) @ rows[-1][4])
    for (got, _), expected in zip(chains.act_all(rows), one):
        assert got == pytest.approx(expected, rel=1e-9, abs=1e-25)


def test_leaves_alike_are_worked_out_once(spark, monkeypatch):
    leaves = [f"l{k}" for k in range(30)]
    annotated = spark.createDataFrame([(0, "r", None, []), *((0, n, "r", [SIDE]) for n in leaves)], ANNOTATED)
    levels = spark.createDataFrame([("r", 0), *((n, 1) for n in leaves)], "node_id string, level int")
    states, nodes, own = chains.tree_states(annotated, levels, N)
    rates = chains.rate_rows(states.where("chain != 'root'"), own, chains.Rates(*RATES), trim)
    tree = spark.createDataFrame([("r", None, 0, 0.0, 0.0, 1), *((n, "r", 1, 0.4, 0.0, 1) for n in leaves)], "node_id string, parent_id string, level int, length double, spine double, abundance int")
    seen, plain = [], chains.acted
    monkeypatch.setattr(chains, "acted", lambda rows, columns: (seen.append(rows.count()), plain(rows, columns))[1])
    status = spark.createDataFrame([(0, n, mask([tract(SIDE)])) for n in leaves], "barcode int, node_id string, status long")
    (got,) = chains.likelihood(tree, nodes, rates, status, chains.Rates(*RATES)).collect()
    known = sorted({mask(t) for t in plain_close([SIDE], {()}, 1, 1)})
    p = (series(dense([SIDE], known), 0.4)[:-1, :-1] @ np.array([float(s == mask([tract(SIDE)])) for s in known]))[known.index(0)]
    assert seen == [1] and got.log_lik == pytest.approx(30 * np.log(p), rel=1e-8)
