"""Linked suppression by brute force, and the analysis summary."""

import itertools
import random

import pytest

from offersieve.plans import linked, summary
from tests.test_analytics import records


def tables_like(published, hidden, rows, columns, most):
    """All values that the hidden places may have, given the published ones: every table of small numbers is tried."""
    inner = [(r, c) for r in rows for c in columns]
    free = [p for p in inner if p in hidden]
    found = {p: set() for p in hidden}
    for guess in itertools.product(range(most + 1), repeat=len(free)):
        t = {p: published.get(p) for p in inner} | dict(zip(free, guess, strict=True))
        t |= {(r, None): sum(t[r, c] for c in columns) for r in rows} | {(None, c): sum(t[r, c] for r in rows) for c in columns}
        t[None, None] = sum(t[p] for p in inner)
        if all(t[p] == v for p, v in published.items()):
            for p in hidden:
                found[p].add(t[p])
    return found


def with_margins(inner, rows, columns):
    t = dict(inner) | {(r, None): sum(inner[r, c] for c in columns) for r in rows} | {(None, c): sum(inner[r, c] for r in rows) for c in columns}
    return t | {(None, None): sum(inner.values())}


def test_computable_is_what_brute_force_finds():
    rng = random.Random(1)
    for _ in range(120):
        rows, columns = ["a", "b", "c"][: rng.randint(2, 3)], ["x", "y", "z"][: rng.randint(2, 3)]
        t = with_margins({(r, c): rng.choice([0, 0, 1, 1, 2]) for r in rows for c in columns}, rows, columns)
        hidden = {p for p in t if rng.random() < 0.45}
        if sum(None not in p for p in hidden) > 6:
            continue
        possible = tables_like({p: v for p, v in t.items() if p not in hidden}, hidden, rows, columns, 6)
        arcs = {p: linked._arc(p) for p in t}
        # Values beyond 6 are not tried, so a place free upwards may show fewer values, but never one alone.
        assert linked.computable(t, hidden, arcs) == {p for p, v in possible.items() if len(v) == 1}, (t, hidden)


def test_protected_tables_tell_no_hidden_number():
    rng = random.Random(2)
    for _ in range(60):
        rows, columns = ["a", "b", "c"], ["x", "y"]
        n = with_margins({(r, c): rng.choice([0, 1, 1, 2, 3, 4]) for r in rows for c in columns}, rows, columns)
        j = with_margins({p: rng.randint(0, v) for p, v in n.items() if None not in p}, rows, columns)
        hidden = linked.protect([n, j], 2)
        assert {p for p, v in n.items() if v == 1} <= hidden
        for m in (n, j):
            if n[None, None] in (0, 1) or not any(m.values()):
                continue
            possible = tables_like({p: v for p, v in m.items() if p not in hidden}, hidden, rows, columns, 5)
            told = {p for p, v in possible.items() if len(v) == 1}
            # Only where everything with a record is hidden already can a number be left that follows.
            assert not told or all(p in hidden for p in n if n[p]), (n, j, hidden, told)


def test_one_dimension():
    n = {("a", None): 9, ("b", None): 1, ("c", None): 6, ("d", None): 5, (None, None): 21}
    r = {("a", None): 3, ("b", None): 0, ("c", None): 2, ("d", None): 0, (None, None): 5}
    assert linked.protect([n], 2, single=True) == {("b", None), ("d", None)}
    # b and d have no rejection together, which would tell that neither has one.
    assert linked.protect([n, r], 2, single=True) == {("b", None), ("d", None), ("c", None)}
    with pytest.raises(ValueError, match="publish fewer"):
        linked.protect([{(str(i), None): 1 for i in range(linked.MAX_PLACES + 1)}], 2)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        rows.append({"city": rng.choice(["上海"] * 8 + ["广州"] * 4 + ["杭州", "北京", None]), "channel": rng.choice(["官网"] * 6 + ["内推"] * 3 + ["Boss"]), "offer_status": rng.choice(["已入职", "待入职", "拒绝offer", "拒绝口头offer", "offer审批中", "其他", "未知"]), "school": f"校{i % 40}"})
    return records(spark, rows)


def test_linked_tables_are_sound(people):
    out = linked.linked_table(people, "city", "channel", least=12)
    got = {(r.row_key, r.column_key): r for r in out.collect()}
    assert all((r.n_total is None) == r.hidden == (r.n_core is None) for r in got.values()) and any(r.hidden for r in got.values())
    assert all(r.hidden or r.n_total >= 12 for r in got.values())
    shown = sum(r.n_total for (a, b), r in got.items() if b is None and a and not r.hidden)
    assert got[None, None].hidden or shown <= got[None, None].n_total == 400
    one = linked.linked_table(people, "school", least=11, top=5).collect()
    assert {r.row_key for r in one if r.row_key} == {linked.REST, *(r.row_key for r in one if r.row_key and r.row_key.startswith("校"))} and len(one) == 7
    assert linked.linked_table(people.where("false"), "city", "channel").count() == 0


def test_summary_of_people(people):
    rows = {(r.section, r.dimension, r.key, r.measure): r.value for r in summary.analysis_summary(people, ("city", "channel")).collect()}
    kpi = {m: v for (s, _, _, m), v in rows.items() if s == "kpi"}
    assert kpi["N"] == 400 == kpi["D"] + kpi["A"] + kpi["U"] and kpi["R"] == kpi["R1"] + kpi["R2"] and kpi["D"] == kpi["J"] + kpi["P"] + kpi["R"]
    assert rows["rejection", None, None, "excluded"] == kpi["P"] + kpi["A"] + kpi["U"]
    assert sum(v for (s, d, _, m), v in rows.items() if (s, d, m) == ("dimension", "city", "N")) == 400
    profile = summary.rejection_profile(people, ("city",)).collect()
    assert sum(r.rejected_share for r in profile) == pytest.approx(1) == pytest.approx(sum(r.joined_share for r in profile))
    assert all(r.usable == (r.n_rejected_group + r.n_joined_group >= 5) and r.contrast == pytest.approx(100 * (r.rejected_share - r.joined_share)) for r in profile)
    assert not any(d == "channel" for _, d, _, _ in ((r.section, r.dimension, r.key, r.measure) for r in summary.analysis_summary(people, ("city", "channel"), disabled=("channel",)).collect()))
    assert summary.rejection_profile(people.where("offer_status = '未知'")).count() == 0
    assert len(summary.notes("按需求")) == 6 and "薪资对比" in summary.notes("x", ["薪资对比"], False)[6]
