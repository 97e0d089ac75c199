"""A bounded cache from pieces of text to what was worked out for them, one per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache(dict):
    """``fill`` works out many missing keys at once.

    Beyond ``limit`` keys a new generation begins; keys of the one before that are asked for
    again move over, so frequent keys stay and at most two generations are held.
    """

    def __init__(self, work_out: Callable[[list], list], limit: int = 300_000):
        super().__init__()
        self.work_out, self.limit, self.before = work_out, limit, {}

    def fill(self, keys: Iterable) -> None:
        wanted = set(keys)
        missing = [k for k in wanted if k not in self]
        if len(self) + len(missing) > self.limit and self:
            self.before = dict(self)
            self.clear()
            missing = list(wanted)
        if self.before:
            self.update((k, self.before[k]) for k in missing if k in self.before)
            missing = [k for k in missing if k not in self.before]
        if missing:
            self.update(zip(missing, self.work_out(missing)))
