"""Periodic runs of a sequence from its suffix automaton and link-cut access.

The automaton's suffix links form a tree whose node for a class of strings lies above the nodes of the longer
strings that end in them. The prefixes are visited in order. A visit turns the path from a prefix's node to the root into one
path of the decomposition, coloured with the prefix's end; what it takes over is met as pieces of earlier paths, each
with the end of its strings' last occurrence as its colour. A piece coloured e whose lowest node has strings of length up
to L says that the L words up to e stand again up to the end i, and were not met in between: these two
occurrences touch or overlap if i - e <= L, and are then a stretch of period i - e with length L + i - e that no word
on its left extends. Stretches that the next word does not extend are the runs.

States and path trees are flat arrays; a state's first transition is held in them, only branching states have a dict.
"""

from array import array

MIN_LENGTH = 24
MIN_PERIODS = 3


class SuffixAutomaton:
    """States with suffix links, by appending one word (a number) after the other."""

    def __init__(self):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.last = 0

    def state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.word.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def append(self, c: int) -> int:
        """The state of the sequence so far."""
        word, target, more, link, length = self.word, self.target, self.more, self.link, self.length
        own, p = self.state(length[self.last] + 1), self.last
        self.last = own
        q = -1
        while p != -1:
            if word[p] == c:
                q = target[p]
                break
            if word[p] == -1:
                word[p], target[p] = c, own
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: own}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = own
            p = link[p]
        if q == -1:
            link[own] = 0
        elif length[p] + 1 == length[q]:
            link[own] = q
        else:
            clone = self.state(length[p] + 1)
            word[clone], target[clone], link[clone] = word[q], target[q], link[q]
            if q in more:
                more[clone] = more[q].copy()
            while p != -1:
                if word[p] == c:
                    if target[p] != q:
                        break
                    target[p] = clone
                else:
                    others = more.get(p)
                    if others is None or others.get(c) != q:
                        break
                    others[c] = clone
                p = link[p]
            link[q] = link[own] = clone
        return own


class LastOccurrences:
    """The tree's paths as splay trees ordered by depth. All nodes of a path have one colour, kept at its splay root."""

    def __init__(self, parent: array):
        # the root of the tree stands for the empty string and is left out
        self.up = array("i", [p if p > 0 else -1 for p in parent])
        self.left = array("i", [-1]) * len(parent)
        self.right = array("i", [-1]) * len(parent)
        self.colour = array("i", [-1]) * len(parent)

    def splay(self, x: int):
        """Makes x the root of its path's splay tree; the colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            if p == -1 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g == -1:
                turns, top = (x,), p
            elif left[g] == p or right[g] == p:
                turns, top = ((p, x) if (left[g] == p) == (left[p] == x) else (x, x)), g
            else:
                turns, top = (x,), p
            for y in turns:
                p = up[y]
                g = up[p]
                if left[p] == y:
                    b = right[y]
                    left[p], right[y] = b, p
                else:
                    b = left[y]
                    right[p], left[y] = b, p
                if b != -1:
                    up[b] = p
                up[p], up[y] = y, g
                if g != -1:
                    if left[g] == p:
                        left[g] = y
                    elif right[g] == p:
                        right[g] = y
        if top != x:
            self.colour[x] = self.colour[top]

    def access(self, node: int, colour: int):
        """Yields (colour, lowest node) of the pieces on the way up and gives the whole path the new colour."""
        up, right, colours = self.up, self.right, self.colour
        below, x = -1, node
        while x != -1:
            self.splay(x)
            own = colours[x]
            if own != -1:
                yield own, x
            cut = right[x]
            if cut != -1:
                colours[cut] = own
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour


def periodic_runs(words: list[int], least: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches with smallest period q and at least max(least, periods * q)
    words, by start and period; `periods` is at least 2."""
    automaton = SuffixAutomaton()
    nodes = [automaton.append(c) for c in words]
    length, paths, n, found = automaton.length, LastOccurrences(automaton.link), len(words), []
    for i, node in enumerate(nodes):
        for e, x in paths.access(node, i):
            q, same = i - e, length[x]
            if (periods - 1) * q <= same and same + q >= least and (i + 1 == n or words[i + 1] != words[e + 1]):
                found.append((e - same + 1, same + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))
