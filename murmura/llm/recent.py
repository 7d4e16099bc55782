"""What was worked out lately, bounded."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Recent:
    """Values by key in two generations: what a generation of `size` keys didn't ask for is forgotten.

    A single call may ask for more keys than that; all of them are there until the next one.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def learn(self, keys: set[Hashable], work_out: Callable[[list], list]) -> dict:
        """A dictionary that has all the keys; work_out gives the values of those that aren't known."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        new = keys - self.young.keys()
        back = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in back)
        fresh = list(new - back)
        if fresh:
            self.young.update(zip(fresh, work_out(fresh)))
        return self.young
