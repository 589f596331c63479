"""A reader of objects as people and models write them: JSON with commas too many, single quotes, or keys without quotes.

Text becomes tokens (strings, signs, bare words); one pass over them builds values on a stack. Bare words that are no
JSON value are kept as texts, and what they stand in is marked as not clean.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

_TOKEN = re.compile(r"""(?P<text>"(?:\\.|[^"\\])*")|(?P<single>'(?:\\.|[^'\\\n])*')|(?P<sign>[{}\[\],:])|(?P<word>[^\s{}\[\],:"']+|["'])""", re.S)
_CLOSES = {"{": "}", "[": "]"}


class Found(NamedTuple):
    """An object, where it ends in the text, and the objects and arrays in it (itself included) that are not clean."""

    value: dict
    end: int
    unclean: list

    def clean(self, value: Any) -> bool:
        return not any(value is x for x in self.unclean)


def _scalar(token: str) -> tuple[Any, bool]:
    """The value of a string or word, and whether it is one of JSON's."""
    try:
        return json.loads(token), True
    except ValueError:
        return token.strip("'"), False


class _Level:
    """An object or array that is being read: its items so far, and the parts of the item at hand."""

    def __init__(self, sign: str):
        self.sign, self.items, self.key, self.part, self.clean = sign, [], None, [], True

    def take(self, value: Any, clean: bool) -> None:
        self.part.append(value)
        self.clean &= clean

    def wants_key(self) -> bool:
        return self.sign == "{" and self.key is None

    def name(self) -> None:
        if self.key is None and self.part:
            self.key, self.part = str(self.part[-1]), []

    def item(self) -> None:
        """Close the item at hand. Nothing at all, before a sign too many, is no fault."""
        self.clean &= len(self.part) == 1 and not self.wants_key() or not self.part and self.key is None
        if self.part:
            self.items.append((self.key, self.part[0]))
        self.key, self.part = None, []

    def value(self) -> Any:
        return dict((k, v) for k, v in self.items if k is not None) if self.sign == "{" else [v for _, v in self.items]


def read_object(text: str, at: int, open_ended: bool = False) -> Found | None:
    """The object that begins at a brace, if it ends; open_ended: or the text does."""
    stack: list[_Level] = []
    unclean: list = []
    for m in _TOKEN.finditer(text, at):
        token = m[0]
        if m.lastgroup != "sign":
            name = token[1:-1] if m.lastgroup == "single" else token
            if stack[-1].wants_key() and m.lastgroup != "text" and re.fullmatch(r"\w+", name):
                stack[-1].take(name, True)
            else:
                stack[-1].take(*_scalar(token))
        elif token in _CLOSES:
            stack.append(_Level(token))
        elif token == ":":
            stack[-1].name()
        else:
            stack[-1].item()
            if token != ",":
                done = stack.pop()
                value = done.value()
                if _CLOSES[done.sign] != token:
                    return None
                if not done.clean:
                    unclean.append(value)
                if not stack:
                    return Found(value, m.end(), unclean)
                stack[-1].take(value, done.clean)
    while open_ended and stack:
        done = stack.pop()
        done.item()
        unclean.append(value := done.value())
        if not stack:
            return Found(value, len(text), unclean)
        stack[-1].take(value, False)
    return None


def objects(text: str) -> Iterator[Found]:
    """The outermost objects of a text; a brace that nothing closes is passed over."""
    at = text.find("{")
    while at >= 0:
        found = read_object(text, at)
        if found:
            yield found
        at = text.find("{", found.end if found else at + 1)
