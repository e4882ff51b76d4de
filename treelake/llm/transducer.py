"""A minimal acyclic transducer from sorted terms to their places in that order."""

from __future__ import annotations

from collections.abc import Iterable


class Transducer:
    """Byte strings to ordinals and back; built from strictly ascending terms in one pass.

    Only the path of the last term is open. What leaves it is final, and is replaced by an equal state where there is one,
    so no two states ever accept the same endings. An arc carries the number of terms that come before those behind it, and
    the sum of these along a term's path is its ordinal. Terms out of order raise ValueError.
    """

    def __init__(self, terms: Iterable[bytes]):
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], list[int], list[int]]] = [([False], [], [])]
        last = None

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                end, labels, targets = path.pop()
                target = self._state(known, end[0], labels, targets)
                path[-1][2].append(target)

        for term in terms:
            if last is not None and term <= last:
                raise ValueError("terms must ascend")
            same = 0
            if last is not None:
                most = min(len(term), len(last))
                while same < most and term[same] == last[same]:
                    same += 1
            close(same)
            for label in term[same:]:
                path[-1][1].append(label)
                path.append(([False], [], []))
            path[-1][0][0] = True
            last = term
        close(0)
        end, labels, targets = path[0]
        self.root = self._state(known, end[0], labels, targets)

    def _state(self, known: dict, final: bool, labels: list[int], targets: list[int]) -> int:
        key = final, tuple(labels), tuple(targets)
        if key not in known:
            known[key] = len(self.arcs)
            before, arcs = int(final), {}
            for label, target in zip(labels, targets, strict=True):
                arcs[label] = target, before
                before += self.size[target]
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(before)
        return known[key]

    def __len__(self) -> int:
        return self.size[self.root]

    def ordinal(self, term: bytes) -> int:
        """The place of a term from 0 on; -1 for one that isn't there."""
        state, n, arcs = self.root, 0, self.arcs
        for label in term:
            arc = arcs[state].get(label)
            if arc is None:
                return -1
            state = arc[0]
            n += arc[1]
        return n if self.final[state] else -1

    def term(self, ordinal: int) -> bytes:
        """The term at a place."""
        if not 0 <= ordinal < len(self):
            raise IndexError(ordinal)
        state, out = self.root, bytearray()
        while not (self.final[state] and ordinal == 0):
            label, (target, before) = max(((x, a) for x, a in self.arcs[state].items() if a[1] <= ordinal), key=lambda x: x[1][1])
            out.append(label)
            state, ordinal = target, ordinal - before
        return bytes(out)
