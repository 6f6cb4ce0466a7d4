"""Read rows back from their printed form, ``Row(name=value, ...)``.

A value is a quoted text (with escapes), a list, a number, ``True``, ``False`` or
``None``. Texts are read whole, so brackets, commas and ``name=`` inside them mean
nothing. A row that breaks off (a cut text, a missing bracket) keeps the fields before
the break and is marked incomplete; the scan goes on at the next ``Row(name=``.
"""

from __future__ import annotations

import ast
import re
from typing import Any

_START = re.compile(r"\bRow\((?=\s*\w+\s*=|\))")
_NAME = re.compile(r"\s*(\w+)\s*=\s*")
_TEXT = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""", re.DOTALL)
_WORD = re.compile(r"[\w.+-]+")
_NEXT = re.compile(r"\s*([,)\]])\s*")
_QUOTED = "'\""
_CONSTANTS = {"True": True, "False": False, "None": None}


class _Broken(ValueError):
    pass


def _value(text: str, at: int) -> tuple[Any, int]:
    """The value that starts at ``at``, and where it ends."""
    if text.startswith("[", at):
        out, at = [], at + 1
        empty = re.compile(r"\s*\]").match(text, at)
        if empty:
            return out, empty.end()
        while True:
            x, at = _value(text, at)
            out.append(x)
            mark = _NEXT.match(text, at)
            if not mark or mark[1] == ")":
                raise _Broken
            at = mark.end() if mark[1] == "," else mark.end(1)
            if mark[1] == "]":
                return out, at
    found = (_TEXT if text[at:at + 1] in _QUOTED else _WORD).match(text, at) if at < len(text) else None
    if not found:
        raise _Broken
    word = found[0]
    if word in _CONSTANTS:
        return _CONSTANTS[word], found.end()
    try:
        return ast.literal_eval(word), found.end()
    except (ValueError, SyntaxError):
        raise _Broken from None


def rows(text: str) -> list[tuple[dict[str, Any], bool]]:
    """``(fields, complete)`` of every printed row. A text that opens before a row and
    closes after it is not a row's: quotes are only followed inside rows."""
    out, at = [], 0
    while start := _START.search(text, at):
        at, fields, complete = start.end(), {}, text.startswith(")", start.end())
        try:
            while not complete:
                name = _NAME.match(text, at)
                if not name:
                    raise _Broken
                value, end = _value(text, name.end())
                mark = _NEXT.match(text, end)
                if not mark or mark[1] == "]":
                    raise _Broken
                fields.setdefault(name[1], value)
                at, complete = mark.end(), mark[1] == ")"
        except _Broken:
            pass
        out.append((fields, complete))
    return out
