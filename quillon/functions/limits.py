"""What is decided for a key from the times of what it did before. Times are microseconds; memory() is all that must be kept."""

from __future__ import annotations

MICRO = 1_000_000


class Throttle:
    """At most `most` allowed hits in the last `seconds`; refused ones don't count.

    A refused hit is answered unless an answer was given within the last half of the window.
    """

    def __init__(self, most: int, seconds: int):
        self.most, self.window = most, seconds * MICRO
        self.allowed: list[int] = []
        self.answered: int | None = None

    def recall(self, times: list[int]) -> None:
        """Allowed hits as they are, the last answer as a negative number."""
        self.allowed = [t for t in times if t >= 0]
        self.answered = next((-t - 1 for t in times if t < 0), None)

    def memory(self) -> list[int]:
        return self.allowed + ([-self.answered - 1] if self.answered is not None else [])

    def forgets(self, last: int) -> int:
        return last + self.window

    def decide(self, at: int) -> tuple[bool, int, bool]:
        """Whether it is allowed, how many are in the window then, and whether a refusal is answered."""
        self.allowed = [t for t in self.allowed if at - t < self.window]
        if self.answered is not None and at - self.answered > self.window:
            self.answered = None
        if len(self.allowed) < self.most:
            self.allowed.append(at)
            return True, len(self.allowed), False
        reply = self.answered is None or at - self.answered > self.window // 2
        if reply:
            self.answered = at
        return False, len(self.allowed), reply


class Sightings:
    """A sighting is fresh unless a fresh one lies less than `seconds` before it."""

    def __init__(self, seconds: int):
        self.span = seconds * MICRO
        self.last: int | None = None

    def recall(self, times: list[int]) -> None:
        self.last = times[0] if times else None

    def memory(self) -> list[int]:
        return [] if self.last is None else [self.last]

    def forgets(self, last: int) -> int:
        return last + self.span

    def decide(self, at: int) -> tuple[bool]:
        fresh = self.last is None or at - self.last >= self.span
        if fresh:
            self.last = at
        return (fresh,)
