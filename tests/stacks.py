"""Undo and redo as two plain stacks: what the folds and streams are compared with."""

from __future__ import annotations

import json


class Stacks:
    """Undo and redo stacks of one document, and the lock a long operation may hold.

    A command whose coalesce key is that of the command on top takes its place.  While a lock is held, commands of others
    and every undo and redo are dropped, a second lock is refused, and only its owner can release it.
    """

    def __init__(self, undo=(), redo=(), keys=None, holder=None):
        self.undo, self.redo = list(undo), list(redo)
        self.keys, self.holder = dict(keys or {}), holder

    def apply(self, op: str, item, key=None, owner=None) -> None:
        if op == "lock":
            self.holder = self.holder or (owner,)
        elif op == "unlock":
            if self.holder == (owner,):
                self.holder = None
        elif op in ("undo", "redo"):
            source, target = (self.undo, self.redo) if op == "undo" else (self.redo, self.undo)
            if self.holder is None and source:
                target.append(source.pop())
        elif self.holder in (None, (owner,)):
            for gone in [self.redo.pop() for _ in self.redo[:]]:
                self.keys.pop(gone, None)
            if key is not None and self.undo and self.keys.get(self.undo[-1]) == key:
                self.keys.pop(self.undo.pop())
            self.undo.append(item)
            if key is not None:
                self.keys[item] = key

    def dump(self) -> str:
        return json.dumps([self.undo, self.redo, list(self.keys.items()), self.holder])

    @classmethod
    def load(cls, text: str) -> Stacks:
        undo, redo, keys, holder = json.loads(text)
        return cls(undo, redo, dict(map(tuple, keys)), holder and tuple(holder))
