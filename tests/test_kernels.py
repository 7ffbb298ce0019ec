from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import kernels as k
from millrace.plans import mixture as m

lengths = st.lists(st.integers(1, 40), max_size=60)


def covered(bins, sizes):
    """Each (record, place) once, none twice."""
    seen = Counter((i, p) for parts in bins for i, a, z in parts for p in range(a, z))
    assert all(c == 1 for c in seen.values())
    return Counter(i for i, _ in seen), sum(seen.values())


@given(st.lists(st.integers(0, 12), min_size=1, max_size=5))
def test_interleave_gives_all_and_stays_near_the_shares(counts):
    order = k.interleave(counts)
    assert Counter(order) == Counter({i: c for i, c in enumerate(counts) if c})
    total, given_ = sum(counts), Counter()
    for n, c in enumerate(order, 1):
        given_[c] += 1
        assert abs(given_[c] - Fraction(counts[c], total) * n) <= len(counts)


def test_interleave_by_hand():
    assert k.interleave([2, 1]) == [0, 1, 0]
    assert k.interleave([1, 1, 2]) == [2, 0, 1, 2]
    assert k.interleave([0, 3]) == [1, 1, 1]


def test_token_draws_follow_weights():
    drawn, debt = k.token_draws([0.5, 0.5], [100.0, 10.0], 1100)
    tokens = [sum(c for i, c in zip(drawn, ([100.0, 10.0][d] for d in drawn), strict=True) if i == j) for j in (0, 1)]
    assert abs(tokens[0] / sum(tokens) - 0.5) < 0.02 and abs(sum(debt)) < 1e-6


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=6), st.integers(8, 300))
@settings(max_examples=60)
def test_quotas_are_exact_in_the_long_run(weights, size):
    w = {i: x / sum(weights) for i, x in enumerate(weights)}
    quotas, total = m.Quotas(size), Counter()
    for n in range(1, 40):
        q = quotas.next(w)
        assert sum(q.values()) == size and min(q.values()) >= 0
        total.update(q)
        assert all(abs(total[i] - w[i] * size * n) < 2 for i in w)


def simulate_shuffle(cursors, size, seed, lane):
    """The buffer record by record, told plainly."""
    warm = 0 if size <= 1 else max(1, min(128, size // 16))
    buffer, out = [], []
    pending = [(i, k.salt(c)) for i, c in enumerate(cursors)]
    for i, mark in pending:
        buffer.append(i)
        target = 0 if size == 1 else min(size, warm + len(out))
        if len(buffer) > target:
            v = k._victim(seed, lane, mark, len(out), len(buffer))
            buffer[v], buffer[-1] = buffer[-1], buffer[v]
            out.append(buffer.pop())
    while buffer:
        v = k._victim(seed, lane, k._DRAIN, len(out), len(buffer))
        buffer[v], buffer[-1] = buffer[-1], buffer[v]
        out.append(buffer.pop())
    return out


@given(st.integers(0, 200), st.integers(1, 80), st.integers(0, 9))
@settings(max_examples=50)
def test_shuffle_is_a_bounded_permutation(n, size, seed):
    cursors = [(i // 8, i % 8, 0, 0, i) for i in range(n)]
    out = k.shuffle_stream(cursors, size, seed, 1)
    assert sorted(out) == list(range(n)) and out == simulate_shuffle(cursors, size, seed, 1)
    assert all(number < place + size + 1 for place, number in enumerate(out))
    if size == 1:
        assert out == list(range(n))


@given(lengths, st.booleans(), st.integers(1, 6), st.sampled_from(["fifo", "fullest"]), st.sampled_from([None, 1, 3]))
def test_whole_record_packing(sizes, best, bins, evict, most):
    got = k.pack_fit(sizes, 30, best=best, num_bins=bins, evict=evict, most_parts=most)
    per, _ = covered(got, sizes)
    assert dict(per) == {i: n for i, n in enumerate(sizes) if n <= 30}
    assert all(sum(z - a for _, a, z in p) <= 30 and len(p) <= (most or 99) for p in got)


def test_fit_by_hand():
    assert k.pack_fit([6, 7, 3, 4, 10], 10) == [[(4, 0, 10)], [(0, 0, 6), (2, 0, 3)], [(1, 0, 7)], [(3, 0, 4)]]
    assert k.pack_fit([6, 7, 3], 10) == [[(0, 0, 6), (2, 0, 3)], [(1, 0, 7)]]
    assert k.pack_fit([6, 7, 3], 10, best=True) == [[(1, 0, 7), (2, 0, 3)], [(0, 0, 6)]]
    assert k.pack_fit([6, 7, 8], 10, num_bins=2) == [[(0, 0, 6)], [(1, 0, 7)], [(2, 0, 8)]]
    assert k.pack_fit([6, 7, 8], 10, num_bins=2, evict="fullest") == [[(1, 0, 7)], [(0, 0, 6)], [(2, 0, 8)]]


@given(lengths, st.sampled_from([None, 1, 2, 4]))
def test_wrap(sizes, most):
    got = k.pack_wrap(sizes, 16, most)
    _, total = covered(got, sizes)
    flat = [(i, p) for parts in got for i, a, z in parts for p in range(a, z)]
    assert flat == sorted(flat)
    assert total == (sum(sizes) // 16 * 16 if most is None else sum(sizes))


@given(lengths, st.integers(1, 8), st.sampled_from([None, 2]), st.sampled_from([None, 3]))
def test_best_fit_wrap_keeps_every_token(sizes, pool, age, most):
    got = k.pack_best_fit_wrap(sizes, 16, pool=pool, most_age=age, most_parts=most)
    per, total = covered(got, sizes)
    assert total == sum(sizes) and all(sum(z - a for _, a, z in p) <= 16 for p in got)
    if most is None:
        assert sum(sum(z - a for _, a, z in p) < 16 for p in got) <= 1


@given(st.lists(st.integers(0, 2), max_size=80), st.integers(2, 20))
def test_ensure_mixture_emits_each_once(kinds, most):
    records = [k.Weighed(((c, 1.0),), i // 20) for i, c in enumerate(kinds)]
    targets = {i: {0: 0.5, 1: 0.3, 2: 0.2} if i % 2 == 0 else {0: 0.7, 1: 0.3} for i in range(5)}
    assert sorted(k.ensure_mixture(records, targets, most)) == list(range(len(kinds)))
    strict = k.ensure_mixture(records, targets, None)
    assert len(set(strict)) == len(strict)


def test_ensure_mixture_alternates():
    kinds = [0, 0, 0, 1, 1, 1]
    order = k.ensure_mixture([k.Weighed(((c, 1.0),)) for c in kinds], {0: {0: 0.5, 1: 0.5}}, 100)
    assert [kinds[i] for i in order] == [0, 1, 0, 1, 0, 1]
    several = [k.Weighed(((0, 2.0), (1, 1.0))), k.Weighed(((1, 1.0),)), k.Weighed(((0, 1.0),))]
    assert sorted(k.ensure_mixture(several, {0: {0: 0.5, 1: 0.5}}, 2)) == [0, 1, 2]


def test_schedule_policies():
    two = [m.Source(100, "stop"), m.Source(1000, "stop")]
    chunks = m.schedule(two, [0.5, 0.5], 30)
    assert len(chunks) == 6 and all(sum(c.counts().values()) == 30 for c in chunks)
    assert len(m.schedule([m.Source(100, "stop")], [1.0], 30)) == 3
    again = m.schedule([m.Source(100, "repeat"), m.Source(40, "repeat")], [0.5, 0.5], 20, stop_after_passes=1)
    assert sum(c.counts()[0] for c in again) == 100
    assert [p for c in again for p in c.pieces if p[0] == 1 and p[1] > 0]
    shared = m.schedule([m.Source(10, "redistribute"), m.Source(50, "redistribute")], [0.5, 0.5], 16)
    assert sum(sum(c.counts().values()) for c in shared) == 60 and shared[-1].exhausted == [0, 1]
    with pytest.raises(ValueError):
        m.schedule([m.Source(10, "repeat")], [1.0], 4)
    with pytest.raises(ValueError):
        m.MixtureSpec({"a": 0.0})
    with pytest.raises(ValueError):
        m.fixed_quotas([0.01, 0.99], 10)
    assert m.fixed_quotas([0.5, 0.3, 0.2], 11) == [6, 3, 2]


def test_ramp():
    assert Counter(k.ramp(200, 64)).most_common(2)[0][1] == 64 and k.ramp(12, 64)[:10] == [0] * 4 + [1] * 6
