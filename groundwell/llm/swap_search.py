"""Best-fit packing of lengths and the swaps between underfull bins that empty the lightest ones.

Every accepted step takes tokens from a lighter bin to a fuller one, so the sum of the squared fills grows and the
search ends. A step moves one document, exchanges one for one, two of the lighter bin for one of the
fuller, or one of the lighter for two of the fuller.
"""

from collections import defaultdict

# The search ends when so many bins in a row could not be emptied.
PATIENCE = 64


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of lengths: each length, longest first, into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set where a bin has r tokens of room
    for length in sorted(lengths, reverse=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[number].append(length)
        else:
            room, number = limit, len(bins)
            bins.append([length])
        left = room - length
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins


class Search:
    """Bins with an index of what the underfull ones hold: bins by room, and by room and the length of a
    document or the lengths of two together."""

    def __init__(self, bins: list[list[int]], limit: int):
        self.bins, self.limit = [sorted(b) for b in bins], limit
        self.room = [limit - sum(b) for b in self.bins]
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.ones: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.twos: dict[tuple[int, int], set[int]] = defaultdict(set)
        for number in range(len(self.bins)):
            self.enter(number)

    def entries(self, number: int):
        own, room = self.bins[number], self.room[number]
        distinct = sorted(set(own))
        twice = {a for a, b in zip(own, own[1:]) if a == b}
        singles = [(room, a) for a in distinct]
        pairs = {(room, a + b) for k, a in enumerate(distinct) for b in distinct[k + 1 :]} | {(room, 2 * a) for a in twice}
        return singles, pairs

    def enter(self, number: int):
        if self.room[number] and self.bins[number]:
            singles, pairs = self.entries(number)
            self.by_room[self.room[number]].add(number)
            for key in singles:
                self.ones[key].add(number)
            for key in pairs:
                self.twos[key].add(number)

    def leave(self, number: int):
        if self.room[number] and self.bins[number]:
            singles, pairs = self.entries(number)
            for index, keys in ((self.by_room, [self.room[number]]), (self.ones, singles), (self.twos, pairs)):
                for key in keys:
                    index[key].discard(number)
                    if not index[key]:
                        del index[key]

    def exchange(self, light: int, full: int, out: tuple, back: tuple):
        """`out` goes from the light bin to the fuller one, `back` the other way. The light bin is in no index."""
        self.leave(full)
        for a in out:
            self.bins[light].remove(a)
            self.bins[full].append(a)
        for a in back:
            self.bins[full].remove(a)
            self.bins[light].append(a)
        gain = sum(out) - sum(back)
        self.bins[full].sort()
        self.bins[light].sort()
        self.room[light] += gain
        self.room[full] -= gain
        self.enter(full)

    def pair_of(self, number: int, total: int) -> tuple[int, int]:
        own = self.bins[number]
        for k, a in enumerate(own):
            if total - a in own[k + 1 :]:
                return a, total - a
        raise KeyError(total)

    def step(self, light: int) -> bool:
        """One move or exchange out of the light bin: whatever fills a fuller bin up most."""
        own = self.bins[light]
        rooms = sorted(self.by_room, reverse=True)
        if not rooms:
            return False
        distinct = sorted(set(own), reverse=True)
        # a move, into the bin that it fills best
        for a in distinct:
            fitting = [r for r in rooms if r >= a]
            if fitting:
                self.exchange(light, min(self.by_room[fitting[-1]]), (a,), ())
                return True
        fill = self.limit - self.room[light]
        pairs = sorted({a + b for k, a in enumerate(own) for b in own[k + 1 :]}, reverse=True)
        for room in rooms:  # an exchange that fills a bin, the largest room first
            for a in distinct:
                if a > room and (held := self.ones.get((room, a - room))):
                    self.exchange(light, min(held), (a,), (a - room,))
                    return True
                if a > room and (held := self.twos.get((room, a - room))):
                    number = min(held)
                    self.exchange(light, number, (a,), self.pair_of(number, a - room))
                    return True
            for total in pairs:
                if total > room and (held := self.ones.get((room, total - room))):
                    self.exchange(light, min(held), self.pair_of(light, total), (total - room,))
                    return True
        for room in rooms:  # an exchange that fills a bin in part, and makes it fuller than the light one was
            for gain in range(room - 1, 0, -1):
                if self.limit - room + gain <= fill:
                    break
                for a in distinct:
                    if a > gain and (held := self.ones.get((room, a - gain))):
                        self.exchange(light, min(held), (a,), (a - gain,))
                        return True
        return False

    def run(self) -> list[list[int]]:
        """Empties the lightest bins as long as the other bins have the room, and returns the bins."""
        queue = sorted((k for k, b in enumerate(self.bins) if b and self.room[k]), key=lambda k: (-self.room[k], k))
        spare, failed = sum(self.room[k] for k in queue), 0
        for light in queue:
            if spare < self.limit or failed == PATIENCE:
                break  # as few bins as the lengths' sum allows, or nothing left to gain
            if not self.bins[light] or not self.room[light]:
                continue
            self.leave(light)
            while self.bins[light] and self.step(light):
                pass
            if self.bins[light]:
                self.enter(light)
                failed += 1
            else:
                spare -= self.limit
                failed = 0
        return [b for b in self.bins if b]


def packed_lengths(bins: list[list[int]], limit: int) -> list[list[int]]:
    return Search(bins, limit).run()
