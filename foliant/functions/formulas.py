"""Readers of formulas, LaTeX and equation scripts, of any depth.

A reader turns tokens into a program for a stack: leaves put a text on it, operations take their operands from it. So
neither reading nor working out needs recursion. Frames are rows, open until their end, and operations, open until they
have their operands; an infix operation takes the item before it, with its scripts, as first operand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: An item of a program: a leaf's text, or an operation's name and the number of its operands.
Step = str | tuple[str, int]
LATEX = re.compile(r"\\[A-Za-z]+|\\.|\s+|.", re.S)
SCRIPT = re.compile(r'\s+|"[^"]*"|[A-Za-z][A-Za-z0-9]*|\d+(?:\.\d+)?|->|!=|\+-|-\+|.', re.S)


class Frame:
    """An open row (arity None), or an open operation; open_end: an operation that scripts may still join."""

    __slots__ = ("arity", "count", "end", "name", "open_end")

    def __init__(self, name: str, arity: int | None = None, end: str = "", count: int = 0, open_end: bool = False):
        self.name, self.arity, self.end, self.count, self.open_end = name, arity, end, count, open_end


class Program:
    def __init__(self):
        self.steps: list[Step] = []
        self.frames = [Frame("")]
        self.space = False

    def item(self) -> None:
        """What stands on top is complete: it may complete operations."""
        while True:
            top = self.frames[-1]
            top.count += 1
            if top.arity is None or top.count < top.arity or top.open_end:
                return
            self.close()

    def close(self) -> None:
        """The operation on top ends; what it lacks is empty."""
        top = self.frames.pop()
        self.steps += [""] * (top.arity - top.count)
        self.steps.append((top.name, top.arity))

    def ready(self) -> None:
        """Before a new item: an infix operation has its second operand, and a space is one item more."""
        while self.frames[-1].open_end and self.frames[-1].count == 2:
            self.close()
            self.item()
        if self.space and self.frames[-1].arity is None and self.frames[-1].count:
            self.steps.append(" ")
            self.frames[-1].count += 1
        self.space = False

    def leaf(self, text: str) -> None:
        self.ready()
        self.steps.append(text)
        self.item()

    def begin(self, name: str, arity: int) -> None:
        self.ready()
        self.frames.append(Frame(name, arity))

    def row(self, name: str, end: str) -> None:
        self.ready()
        self.frames.append(Frame(name, None, end))

    def finish(self) -> Frame:
        """Ends the row that is open, and the operations open in it."""
        self.space = False
        while self.frames[-1].arity is not None:
            self.close()
            self.item()
        top = self.frames.pop()
        self.steps.append(("row", top.count))
        return top

    def end(self, mark: str) -> bool:
        """Ends the innermost row with that end, and rows open in it; False where there is none."""
        if not any(f.arity is None and f.end == mark for f in self.frames):
            return False
        while True:
            top = self.finish()
            if top.name == "group" and self.frames[-1].arity is None:
                self.steps.append(("group", 1))
            elif top.name not in ("", "group"):
                self.wrapped(top)
            self.item()
            if top.end == mark:
                return True

    def wrapped(self, row: Frame) -> None:
        self.steps.append((row.name, 1))

    def taken(self) -> int:
        """Takes the item before as an operand, an empty one where there is none."""
        self.space = False
        top = self.frames[-1]
        if top.count:
            top.count -= 1
        else:
            self.steps.append("")
        return 1

    def infix(self, name: str) -> None:
        self.space = False
        self.ready()
        while self.frames[-1].arity is not None:
            self.close()
            self.item()
        count = self.taken()
        if self.steps[-1] == ("group", 1):
            self.steps.pop()
        self.frames.append(Frame(name, 2, count=count, open_end=True))

    def script(self, sign: str) -> None:
        self.frames.append(Frame(sign, 2, count=self.taken()))

    def done(self) -> list[Step]:
        while len(self.frames) > 1:
            if self.frames[-1].arity is not None:
                self.close()
            else:
                top = self.finish()
                if top.name not in ("", "group"):
                    self.wrapped(top)
            self.item()
        self.steps.append(("row", self.frames[0].count))
        return self.steps


def worked_out(steps: Iterable[Step], make: Callable[[str, list], object], leaf: Callable[[str], object] = str) -> object:
    """What a program gives when each operation is worked out from its operands."""
    stack: list = []
    for s in steps:
        if isinstance(s, str):
            stack.append(leaf(s))
        else:
            name, n = s
            at = len(stack) - n
            args = stack[at:]
            del stack[at:]
            stack.append(make(name, args))
    return stack[-1]


def after_space(tokens: list[str], at: int) -> int:
    """The place of the first token from `at` on that is no white space."""
    while at < len(tokens) and tokens[at].isspace():
        at += 1
    return at


def raw_group(tokens: list[str], at: int) -> tuple[str, int]:
    """The text of the group that begins at a place, and the place after it; of anything else one token."""
    if at >= len(tokens) or tokens[at] != "{":
        return "".join(tokens[at : at + 1]), at + 1
    depth, i = 0, at
    while i < len(tokens):
        depth += (tokens[i] == "{") - (tokens[i] == "}")
        i += 1
        if not depth:
            return "".join(tokens[at + 1 : i - 1]), i
    return "".join(tokens[at + 1 :]), i
