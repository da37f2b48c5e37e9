"""An undo stack of selections: names of tables or lists, bounded in depth."""

from __future__ import annotations

from collections import deque


class History:
    def __init__(self, depth: int = 20):
        self.states: deque = deque(maxlen=depth)

    def push(self, state) -> None:
        self.states.append(state)

    def undo(self):
        """The state before the last one, which is dropped; None if there is none."""
        if self.states:
            self.states.pop()
        return self.states[-1] if self.states else None

    def __len__(self) -> int:
        return len(self.states)
