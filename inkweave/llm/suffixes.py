"""Deep-shallow sorting of strings, and what a sorted group says about common substrings around an anchor."""

from __future__ import annotations

from bisect import bisect_left

#: Bytes that multikey quicksort looks at beyond a group's common prefix; strings still equal there go to a blind trie.
SHALLOW = 12


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the depths at which they part. Insertion looks at single characters on the way down and compares one
    whole string, then places the new leaf by the length of the prefix that the two share."""

    def __init__(self, strings):
        self.strings, self.root = strings, None

    def _character(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(self._character(k, depth)) or next(iter(children.values()))
        other = node[0]
        shared = common(self.strings[k], self.strings[other])
        if shared == len(self.strings[k]) == len(self.strings[other]):
            node.append(k)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            above, node = node, node[1][self._character(k, node[0])]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][self._character(k, shared)] = [k]
            return
        parted = (shared, {self._character(other, shared): node, self._character(k, shared): [k]})
        if above is None:
            self.root = parted
        else:
            above[1][self._character(k, above[0])] = parted

    def ordered(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node:
                yield from node


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort to a shallow depth, blind tries for what is equal up to there."""
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    start = common(min(strings), max(strings))
    stack, out = [(list(range(len(strings))), start)], []
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= start + shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            out += trie.ordered()
        else:
            at = [strings[k][depth] if depth < len(strings[k]) else -1 for k in group]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            less, more = [k for k, c in zip(group, at) if c < pivot], [k for k, c in zip(group, at) if c > pivot]
            same = [k for k, c in zip(group, at) if c == pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:  # they end here, so they are equal
                stack += [([k], depth) for k in reversed(same)]
            else:
                stack.append((same, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def sorted_with_prefixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order, and the common prefix of each string with the next one in it."""
    order = deep_shallow(strings)
    return order, [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def matches(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence of an anchor, with the reversed bytes before it and the bytes from it on: (l, r) such that the l
    bytes before and r bytes from the anchor on stand at another occurrence too, and l + r >= length. Together they
    cover all such substrings.

    Occurrences that share l bytes before the anchor are a run in the sorted left strings. In a run, the longest right
    match of each is with a neighbour in the sorted right strings, so both are sorted once and runs are split as l grows: no pairs."""
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    left_order, left_common = sorted_with_prefixes(lefts)
    right_order, right_common = sorted_with_prefixes(rights)
    place = [0] * n
    for k, i in enumerate(left_order):
        place[i] = k
    stack = [(0, n, right_order, right_common)]
    while stack:
        low, high, members, shared = stack.pop()
        depth = min(left_common[low : high - 1])
        before = 0
        alive = False
        for k, i in enumerate(members):
            after = shared[k] if k < len(shared) else 0
            r = max(before, after)
            before = after
            if depth + r >= length:
                out[i].append((depth, r))
            alive = alive or len(lefts[i]) + r >= length
        if not alive:
            continue
        cuts = [low, *[k + 1 for k in range(low, high - 1) if left_common[k] == depth], high]
        runs = [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        if not runs:
            continue
        run_of = {}
        for number, (a, b) in enumerate(runs):
            run_of.update(dict.fromkeys(range(a, b), number))
        parts = [([], [], []) for _ in runs]  # members, their common prefixes, the last one's place
        at, least = [], []  # places, and the least prefix from there on: ascending
        for k, i in enumerate(members):
            if k:
                while least and least[-1] >= shared[k - 1]:
                    at.pop(), least.pop()
                at.append(k - 1), least.append(shared[k - 1])
            number = run_of.get(place[i])
            if number is not None:
                own, prefixes, last = parts[number]
                if own:
                    prefixes.append(least[bisect_left(at, last[0])])
                own.append(i)
                last[:] = [k]
        stack += [(a, b, own, prefixes) for (a, b), (own, prefixes, _) in zip(runs, parts)]
    return out
