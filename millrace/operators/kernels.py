"""Sequential kernels of one lane and epoch, without Spark.

Each takes records in order and yields decisions about them by number, so that
payloads need not travel through Python. Results depend on the input order and
the options alone.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

_WORD = (1 << 64) - 1
# With other ones a streaming shuffle would deliver another order.
_MUL_A, _MUL_B, _STEP, _DRAIN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_FNV_START, _FNV_PRIME = 0x811C9DC5, 0x01000193


class RoundRobin:
    """Smooth weighted round robin: the largest deficit against the target is
    next; ties go to the earlier component."""

    def __init__(self, target: dict[int, float]):
        self.target = dict(target)
        self.given = {k: 0.0 for k in target}

    def deficits(self) -> dict[int, float]:
        n = max(1.0, sum(self.given.values()))
        return {k: t * n - self.given[k] for k, t in self.target.items()}

    def peek(self, among: Iterable[int] | None = None) -> int | None:
        allowed = self.target.keys() if among is None else set(among)
        best, most = None, -math.inf
        for k, d in self.deficits().items():
            if k in allowed and d > most:
                best, most = k, d
        return best

    def give(self, k: int, weight: float = 1.0) -> None:
        self.given[k] = self.given.get(k, 0.0) + weight

    def retarget(self, target: dict[int, float]) -> None:
        self.target = dict(target)
        self.given = {k: self.given.get(k, 0.0) for k in target}


def interleave(counts: Sequence[int]) -> list[int]:
    """Components of a chunk's slots in order."""
    total = sum(counts)
    if not total:
        return []
    turn = RoundRobin({k: c / total for k, c in enumerate(counts) if c})
    left = list(counts)
    out = []
    for _ in range(total):
        k = turn.peek([k for k in turn.target if left[k]])
        turn.give(k)
        left[k] -= 1
        out.append(k)
    return out


def weighted_random(counts: Sequence[int], seed: int) -> list[int]:
    """Components of a chunk's slots, each drawn by the weights of the
    components that still have samples."""
    import random

    draw, left, out = random.Random(seed), list(counts), []
    while any(left):
        live = [k for k, n in enumerate(left) if n]
        k = draw.choices(live, [counts[i] for i in live])[0]
        left[k] -= 1
        out.append(k)
    return out


def token_draws(weights: Sequence[float], costs: Sequence[float], draws: int, deficit: list[float] | None = None) -> tuple[list[int], list[float]]:
    """Components of ``draws`` slots so that tokens follow the weights."""
    debt = list(deficit) if deficit is not None else [0.0] * len(weights)
    out = []
    for _ in range(draws):
        k = max(range(len(debt)), key=lambda i: (debt[i], -i))
        for i, w in enumerate(weights):
            debt[i] += w * costs[k]
        debt[k] -= costs[k]
        out.append(k)
    return out, debt


def mix64(x: int) -> int:
    x = (x ^ (x >> 30)) * _MUL_A & _WORD
    x = (x ^ (x >> 27)) * _MUL_B & _WORD
    return x ^ (x >> 31)


def salt(parts: Iterable[int]) -> int:
    """32-bit fold of a cursor: of each number the low half, then the high one."""
    h = _FNV_START
    for p in parts:
        for half in (p & 0xFFFFFFFF, p >> 32 & 0xFFFFFFFF):
            h = (h ^ half) * _FNV_PRIME & 0xFFFFFFFF
    return h


def _victim(seed: int, lane: int, mark: int, counter: int, size: int) -> int:
    h = mix64(seed & _WORD)
    for part in (lane, mark, counter, size):
        h = mix64(h ^ mix64(part + _STEP & _WORD))
    return h % size


def shuffle_stream(cursors: Sequence[Sequence[int]], size: int, seed: int, lane: int) -> list[int]:
    """Order of emission of a shuffle buffer that warms up, holds ``size``
    records at most and drains at the end. A cursor is chunk, offset, lineage
    and sample, as one sequence of numbers."""
    warm = 0 if size <= 1 else max(1, min(128, size // 16))
    held: list[int] = []
    out: list[int] = []

    def evict(mark: int) -> None:
        i = _victim(seed, lane, mark, len(out), len(held))
        held[i], held[-1] = held[-1], held[i]
        out.append(held.pop())

    for number, cursor in enumerate(cursors):
        held.append(number)
        if len(held) > (0 if size == 1 else min(size, warm + len(out))):
            evict(salt(cursor))
    while held:
        evict(_DRAIN)
    return out


def ramp(n: int, size: int, growth: float = 1.5) -> list[int]:
    """Block number of each of n records, with blocks that grow up to ``size``."""
    out: list[int] = []
    block, now = 0, 1 if size <= 1 else max(1, min(128, size // 16))
    while len(out) < n:
        out += [block] * min(now, n - len(out))
        block, now = block + 1, min(size, max(now + 1, math.ceil(now * growth)))
    return out


#: What a bin holds: (record, start, stop).
Parts = list[tuple[int, int, int]]


@dataclass
class Bin:
    left: int
    parts: Parts = field(default_factory=list)


def fit_bins(lengths: Iterable[int], capacity: int, *, best: bool = False, num_bins: int = 64, least: int = 1, most_parts: int | None = None, evict: str = "fifo") -> Iterator[Parts]:
    """Bins of (record, start, stop) by first or best fit over open bins, each
    given out when it is closed.

    A bin is emitted when less than ``least`` is left or it has
    ``most_parts``; a new one beyond ``num_bins`` evicts the oldest or the
    fullest. Records longer than the capacity are left out."""
    open_: list[Bin] = []
    full = lambda b: b.left < least or (most_parts is not None and len(b.parts) >= most_parts)
    for number, n in enumerate(lengths):
        if n > capacity or n <= 0:
            continue
        fitting = [b for b in open_ if b.left >= n]
        if fitting:
            chosen = min(fitting, key=lambda b: b.left) if best else fitting[0]
            chosen.parts.append((number, 0, n))
            chosen.left -= n
            if full(chosen):
                yield chosen.parts
                open_ = [b for b in open_ if b is not chosen]
            continue
        new = Bin(capacity - n, [(number, 0, n)])
        if full(new):
            yield new.parts
            continue
        while len(open_) >= num_bins:
            gone = open_[0] if evict == "fifo" else min(open_, key=lambda b: b.left)
            yield gone.parts
            open_ = [b for b in open_ if b is not gone]
        open_.append(new)
    for b in open_:
        yield b.parts


def wrap_bins(lengths: Iterable[int], capacity: int, most_parts: int | None = None) -> Iterator[Parts]:
    """One stream cut at every ``capacity``. Without a cap on parts the tail
    that fills no bin is dropped; with one, it is emitted."""
    now, left = [], capacity
    for number, n in enumerate(lengths):
        at = 0
        while at < n:
            take = min(left, n - at)
            now.append((number, at, at + take))
            at, left = at + take, left - take
            if not left or (most_parts is not None and len(now) >= most_parts):
                yield now
                now, left = [], capacity
    if now and most_parts is not None:
        yield now


def best_fit_wrap_bins(lengths: Iterable[int], capacity: int, *, pool: int = 64, most_age: int | None = None, most_parts: int | None = None) -> Iterator[Parts]:
    """Full windows are cut off; tails wait in a pool from which bins are
    filled: aged tails first, then the largest that fits, last one split of the
    smallest."""
    waiting: list[list[int]] = []  # record, start, stop, arrival
    arrived = 0

    def total() -> int:
        return sum(w[2] - w[1] for w in waiting)

    def build() -> Parts:
        gap, parts = capacity, []
        while gap and waiting and (most_parts is None or len(parts) < most_parts):
            oldest = min(waiting, key=lambda w: w[3])
            size = oldest[2] - oldest[1]
            if most_age is not None and arrived - oldest[3] > most_age and size <= gap:
                chosen = oldest
            else:
                fitting = [w for w in waiting if w[2] - w[1] <= gap]
                chosen = min(fitting, key=lambda w: (-(w[2] - w[1]), w[3])) if fitting else None
            if chosen is not None:
                waiting.remove(chosen)
                parts.append((chosen[0], chosen[1], chosen[2]))
                gap -= chosen[2] - chosen[1]
                continue
            part = min(waiting, key=lambda w: (w[2] - w[1], w[3]))
            size = part[2] - part[1]
            if part[1] == 0 and gap < size - gap:
                parts.append((part[0], part[2] - gap, part[2]))
                part[2] -= gap
            else:
                parts.append((part[0], part[1], part[1] + gap))
                part[1] += gap
            gap = 0
        return parts

    for number, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            yield [(number, at, at + capacity)]
            at += capacity
        if at < n:
            waiting.append([number, at, n, arrived])
            arrived += 1
        while len(waiting) >= pool and (total() >= capacity or (most_parts is not None and len(waiting) >= most_parts)):
            yield build()
    while waiting and (total() >= capacity or (most_parts is not None and len(waiting) > most_parts)):
        yield build()
    if waiting:
        yield [(w[0], w[1], w[2]) for w in sorted(waiting, key=lambda w: w[3])]


def pack_fit(lengths: Sequence[int], capacity: int, **options) -> list[Parts]:
    return list(fit_bins(lengths, capacity, **options))


def pack_wrap(lengths: Sequence[int], capacity: int, most_parts: int | None = None) -> list[Parts]:
    return list(wrap_bins(lengths, capacity, most_parts))


def pack_best_fit_wrap(lengths: Sequence[int], capacity: int, **options) -> list[Parts]:
    return list(best_fit_wrap_bins(lengths, capacity, **options))


@dataclass(frozen=True)
class Weighed:
    """A record for mixture correction: its components with weights."""

    parts: tuple[tuple[int, float], ...]
    chunk: int = 0


def ensure_mixture(records: Sequence[Weighed], targets: dict[int, dict[int, float]], most: int | None = 1000, ratio: float = 0.8, rate: float = 0.1, ended: dict[int, frozenset[int]] | None = None) -> list[int]:
    """Order of emission that follows each chunk's target.

    A record waits in the queue of its component (of several: in a list; of
    none in the target: among the obsolete). The next one is the component with
    the largest deficit; once ``most`` records wait, emission is forced until
    int(ratio * most) do. Obsolete ones leave one in every int(1 / rate).
    Without ``most`` what waits at the end is discarded. ``ended``: for a chunk
    the components whose sources give nothing after it; once its records are in
    they leave the target (all but the last one), so what waits may go on."""
    turn = RoundRobin({})
    single: dict[int, deque[int]] = {}
    several: list[int] = []
    obsolete: deque[int] = deque()
    out: list[int] = []
    newest, since, slot = None, 0, max(1, int(1 / rate)) if rate > 0 else None
    forced = False

    def waiting() -> int:
        return sum(map(len, single.values())) + len(several) + len(obsolete)

    def file(number: int) -> None:
        parts = records[number].parts
        if any(k not in turn.target for k, _ in parts):
            obsolete.append(number)
        elif len(parts) == 1:
            single.setdefault(parts[0][0], deque()).append(number)
        else:
            several.append(number)

    def emit(number: int) -> None:
        nonlocal since
        for k, w in records[number].parts:
            if k in turn.target:
                turn.give(k, w)
        since = min(since + 1, slot) if slot else since + 1
        out.append(number)

    def score(number: int) -> float:
        lack = turn.deficits()
        return sum(w * lack.get(k, 0.0) for k, w in records[number].parts)

    def step(force: bool) -> bool:
        nonlocal since
        if obsolete and slot and since >= slot:
            emit(obsolete.popleft())
            since = 0
            return True
        ideal = turn.peek()
        holders = [i for i in several if any(k == ideal for k, _ in records[i].parts)]
        if ideal is not None and single.get(ideal):
            emit(single[ideal].popleft())
        elif holders:
            best = max(holders, key=lambda i: (score(i), -several.index(i)))
            several.remove(best)
            emit(best)
        elif not force:
            return False
        else:
            have = turn.peek([k for k, q in single.items() if q])
            if have is not None:
                emit(single[have].popleft())
            elif several:
                best = max(several, key=lambda i: (score(i), -several.index(i)))
                several.remove(best)
                emit(best)
            elif obsolete:
                emit(obsolete.popleft())
                since = 0
            else:
                return False
        return True

    over: set[int] = set()

    def aim(target: dict[int, float]) -> None:
        left = {k: w for k, w in target.items() if k not in over}
        if left == turn.target or not left:
            return
        turn.retarget(left)
        again = sorted([i for q in single.values() for i in q] + several + list(obsolete))
        single.clear()
        several.clear()
        obsolete.clear()
        for i in again:
            file(i)

    def drain() -> None:
        nonlocal forced
        while waiting():
            forced = most is not None and (waiting() >= most or forced and waiting() > int(ratio * most))
            if not step(forced):
                break

    def close(chunk: int) -> None:
        fresh = (ended or {}).get(chunk, frozenset()) - over
        if fresh:
            over.update(fresh)
            aim(targets[chunk])
            drain()

    for number, record in enumerate(records):
        if newest is None or record.chunk > newest:
            if newest is not None:
                close(newest)
            newest = record.chunk
            aim(targets[newest])
        file(number)
        drain()
    if newest is not None:
        close(newest)
    if most is not None:
        while step(True):
            pass
    return out
