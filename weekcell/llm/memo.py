"""A bounded memo for the pieces of text that come again and again."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[piece]`` computes a missing piece; the memo starts anew when it holds ``limit`` bytes of keys.

    Pieces longer than ``longest`` are computed each time and not held.
    """

    def __init__(self, compute: Callable[[str], object], limit: int = 64 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.held = compute, limit, longest, 0

    def __missing__(self, piece):
        value = self.compute(piece)
        size = len(piece) if hasattr(piece, "__len__") else 1
        if size <= self.longest:
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self.held += size + 240
            self[piece] = value
        return value


class Generations(dict):
    """A memo that keeps what is in use: when its entries come to ``limit`` bytes they become the former ones, and a former one that is asked for comes back.

    So two generations are held at most. Pieces longer than ``longest`` are computed each time and not held.
    """

    def __init__(self, compute: Callable[[bytes], bytes], limit: int = 112 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.held, self.former = compute, limit, longest, 0, {}

    def __missing__(self, piece):
        value = self.former.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > self.longest:
                return value
        if self.held > self.limit:
            self.former, self.held = dict(self), 0
            self.clear()
        self.held += len(piece) + 240
        self[piece] = value
        return value
