"""A bounded cache for what workers compute of words."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Recent(dict):
    """``cache[key]`` is ``make(key)``; keys not asked for in the last ``size`` to ``2 * size`` new ones are forgotten.

    A full generation becomes the old one; what is asked for again moves back. Keys over ``longest`` characters are
    never kept, so memory is bounded.
    """

    def __init__(self, make: Callable[[Any], Any], size: int = 300_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
