"""Bin completion over a histogram of lengths: which fillings to use, and how often.

Pieces of one length are interchangeable, so a packing is a list of (times, filling) pairs over at most ``capacity``
lengths, whatever the number of pieces.  The best-fit-decreasing packing is the first incumbent.  The search then fills
the bin of the largest piece left with every undominated filling, least waste and largest pieces first, each as often
as the counts allow and then once, and drops a branch whose waste, or whose lower bound on the bins still needed,
cannot beat the incumbent.  A filling is dominated if a piece left out could stand for some of its pieces, or fit in
its waste.  Sets of lengths and of sums are bit sets held in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Filling = tuple[tuple[int, int], ...]  # (length, how many), largest first
Packing = list[tuple[int, Filling]]
#: Steps of the search after which the incumbent is taken; a parameter, and the same for every size of table.
STEPS = 20_000


def bins_of(packing: Packing) -> int:
    return sum(times for times, _ in packing)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: large pieces alone in their bins, and what their bins leave for the others."""
    size = np.arange(capacity + 1)
    number, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * size))
    half = capacity // 2
    alone = number[-1] - number[half + 1]
    least = np.arange(half + 1)  # pieces below are left out
    middle = number[capacity - least + 1] - number[half + 1]
    room = middle * capacity - (total[capacity - least + 1] - total[half + 1])
    rest = total[half + 1] - total[least]
    return int((alone + np.maximum(0, -(-(rest - room) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Best-fit decreasing: each piece, largest first, goes to the fullest bin that takes it."""
    opened: dict[int, list[tuple[int, Filling]]] = {}
    rooms = 0  # bit set of the rooms of open bins
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = rooms >> length
            room = length + (fits & -fits).bit_length() - 1 if fits else capacity
            times, filling = opened[room].pop() if fits else (left, ())
            if fits and not opened[room]:
                rooms &= ~(1 << room)
            each = min(room // length, left)
            used = min(times, left // each)
            for n, f, r in ((used, (*filling, (length, each)), room - each * length), (times - used if fits else 0, filling, room)):
                if n:
                    opened.setdefault(r, []).append((n, f))
                    rooms |= 1 << r
            left -= used * each
    return [group for groups in opened.values() for group in groups]


def _smear(bits: int, width: int) -> int:
    """Bits moved up by 0 to width places."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


class Search:
    """Depth-first bin completion; counts change along the branch and are put back."""

    def __init__(self, counts: np.ndarray, capacity: int, steps: int = STEPS):
        self.counts, self.capacity, self.steps = counts.astype(np.int64).copy(), capacity, steps
        self.total = int((self.counts * np.arange(capacity + 1)).sum())
        self.there, self.mirror = 0, 0
        for length in np.flatnonzero(self.counts).tolist():
            self._mark(length)
        self.looked = 0
        self.best = best_fit(self.counts, capacity)
        self.bins = bins_of(self.best)
        self.bound = lower_bound(self.counts, capacity)

    def _mark(self, length: int) -> None:
        has = self.counts[length] > 0
        a, b = 1 << length, 1 << (self.capacity - length)
        self.there = self.there | a if has else self.there & ~a
        self.mirror = self.mirror | b if has else self.mirror & ~b

    def _take(self, filling: Filling, times: int) -> None:
        for length, n in filling:
            self.counts[length] -= times * n
            self._mark(length)

    def _may_waste(self) -> int:
        return (self.bins - 1) * self.capacity - self.total

    def _dominated(self, filling: Filling, waste: int) -> bool:
        """filling includes the largest piece, which stays."""
        outside = self.there
        largest = filling[0][0]
        one, more = 0, 0
        for length, n in filling:
            if self.counts[length] <= n:
                outside &= ~(1 << length)
            for _ in range(n - (length == largest)):
                more |= (more | one) << length
                one |= 1 << length
        better = _smear(more, waste)
        if waste:
            better |= _smear((one | 1) << 1, waste - 1)
        return bool(outside & better)

    def _fillings(self, spare: int) -> Iterator[tuple[Filling, int]]:
        """Undominated fillings of the bin of the largest piece, and their waste, which is spare at most."""
        largest = self.there.bit_length() - 1
        gap = self.capacity - largest

        def whole(*more: tuple[int, int]) -> Filling:
            merged: dict[int, int] = {largest: 1}
            for length, n in more:
                merged[length] = merged.get(length, 0) + n
            return tuple(sorted(merged.items(), reverse=True))

        def has(filling: Filling) -> bool:
            return all(self.counts[length] >= n for length, n in filling)

        if gap == 0:
            yield whole(), 0
            return
        if gap <= largest and self.there >> gap & 1 and has(whole((gap, 1))):
            yield whole((gap, 1)), 0  # a single piece that leaves no waste dominates every other filling
            return
        pairs = self.there & (self.mirror >> largest) & ((1 << gap) - 1)
        while pairs:
            a = pairs.bit_length() - 1
            if 2 * a < gap:
                break
            pairs &= ~(1 << a)
            if has(whole((a, 1), (gap - a, 1))):
                yield whole((a, 1), (gap - a, 1)), 0
        lengths = [i for i in np.flatnonzero(self.counts[: gap + 1]).tolist()]
        number = [min(int(self.counts[i]) - (i == largest), gap // i) for i in lengths]
        sums, mask = [1], (1 << (gap + 1)) - 1  # sums[i]: what the i least lengths can add up to
        for length, n in zip(lengths, number, strict=True):
            reached, step = sums[-1], 1
            while n > 0:
                step = min(step, n)
                reached |= reached << (step * length) & mask
                n -= step
                step *= 2
            sums.append(reached)

        def exactly(target: int, below: int) -> Iterator[tuple[tuple[int, int], ...]]:
            if not target:
                yield ()
                return
            for i in range(below - 1, -1, -1):
                if not sums[i + 1] >> target & 1:
                    return
                for n in range(min(number[i], target // lengths[i]), 0, -1):
                    if sums[i] >> (target - n * lengths[i]) & 1:
                        for rest in exactly(target - n * lengths[i], i):
                            yield ((lengths[i], n), *rest)

        for waste in range(min(spare, gap) + 1):
            if sums[-1] >> (gap - waste) & 1:
                for found in exactly(gap - waste, len(lengths)):
                    self.looked += 1
                    if self.looked > self.steps:
                        return
                    if not waste and sum(n for _, n in found) <= 2:
                        continue  # these came first
                    filling = whole(*found)
                    if not self._dominated(filling, waste):
                        yield filling, waste

    def _choices(self, wasted: int) -> Iterator[tuple[Filling, int, int]]:
        for filling, waste in self._fillings(self._may_waste() - wasted):
            most = min(int(self.counts[length]) // n for length, n in filling)
            if waste:
                most = min(most, (self._may_waste() - wasted) // waste)
            for times in dict.fromkeys((most, 1)):
                if times > 0:
                    yield filling, times, waste

    def run(self) -> Packing:
        if self.bins <= self.bound:
            return self.best
        wasted, used, taken = 0, 0, []
        frames = [self._choices(0)]
        while frames and self.looked < self.steps:
            self.looked += 1
            choice = next(frames[-1], None)
            if choice is None:
                frames.pop()
                if taken:
                    filling, times, waste = taken.pop()
                    self._take(filling, -times)
                    wasted, used = wasted - times * waste, used - times
                continue
            filling, times, waste = choice
            self._take(filling, times)
            if not self.there and used + times < self.bins:
                self.best = [(t, f) for f, t, _ in taken] + [(times, filling)]
                self.bins = used + times
                if self.bins <= self.bound:
                    break
            if not self.there or wasted + times * waste > self._may_waste() or used + times + lower_bound(self.counts, self.capacity) >= self.bins:
                self._take(filling, -times)
                continue
            taken.append(choice)
            wasted, used = wasted + times * waste, used + times
            frames.append(self._choices(wasted))
        return self.best


def pack_lengths(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Packing:
    """Fillings and how often each is used, for counts[i] pieces of length i (0 to capacity; there are none of length 0)."""
    return Search(counts, capacity, steps).run() if counts.any() else []
