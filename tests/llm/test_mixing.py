from collections import Counter

import pytest

from wareloom.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 7, "b": 11, "c": 13, "d": 2}, mixing.WEIGHTS])
def test_a_period_meets_all_windows_and_stays_within_one_block(weights):
    total = sum(weights.values())
    turns = mixing.period(weights)
    assert sorted(s for _, _, s in turns) == list(range(total))
    assert Counter(n for n, _, _ in turns) == Counter(weights)
    done = Counter()
    for name, k, slot in sorted(turns, key=lambda t: t[2]):
        assert k == done[name]
        assert k * total // weights[name] <= slot < -(-(k + 1) * total // weights[name])
        done[name] += 1
        assert all(abs(done[n] - w * (slot + 1) / total) < 1 for n, w in weights.items())


def test_bad_weights_are_refused():
    with pytest.raises(ValueError):
        mixing.period({"a": 0, "b": 1})


def test_every_row_has_one_place(odd_docs, odd_rows, no_docs):
    rows = mixing.schedule(odd_docs, {"src1": 2, "src2": 1}, block=2).collect()
    assert Counter(tuple(r.doc) for r in rows) == Counter(odd_rows)
    places = [(r.slot, r.place) for r in rows]
    assert len(set(places)) == len(places)
    by_class = Counter(r["class"] for r in rows)
    for name, n in by_class.items():
        assert sorted(2 * r.block + r.place for r in rows if r["class"] == name) == list(range(n))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert mixing.schedule(no_docs).collect() == []


def test_mixed_rows_come_in_slot_order(odd_docs, odd_rows):
    weights = {"src1": 2, "src2": 1}
    out = mixing.mixed(odd_docs, weights, block=2)
    assert out.schema == odd_docs.schema
    slots = {}
    for r in mixing.schedule(odd_docs, weights, block=2).collect():
        slots.setdefault(tuple(r.doc), []).append((r.slot, r.place))
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(odd_rows)
    first = [min(slots[r]) for r in got if len(slots[r]) == 1]
    assert first == sorted(first)
