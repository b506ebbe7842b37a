"""Placeholders of SQL statements in the style of a database driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

#: Texts, quoted names and comments, in which a question mark is no placeholder; then the placeholder.
_PARTS = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$\{(\w+)\}|(\?)""", re.S)
#: How drivers write the n-th placeholder.
STYLES: dict[str, Callable[[int], str]] = {"qmark": lambda n: "?", "dollar": lambda n: f"${n}", "colon": lambda n: f":{n}", "at": lambda n: f"@p{n}", "format": lambda n: "%s"}


def positional(sql: str, style: str = "qmark", first: int = 1) -> str:
    """`?` outside of texts, names and comments as the driver's placeholders, counted from `first`."""
    return _rewritten(sql, style, first)[0]


def named(sql: str, style: str = "qmark", first: int = 1) -> tuple[str, list[str]]:
    """`${name}` as the driver's placeholders, and the names in the order in which values must be given."""
    return _rewritten(sql, style, first)


def _rewritten(sql: str, style: str, first: int) -> tuple[str, list[str]]:
    if style not in STYLES:
        raise ValueError(f"no placeholder style {style}")
    names: list[str] = []
    n = first

    def put(m: re.Match) -> str:
        nonlocal n
        if m[1] is None and m[2] is None:
            return m[0]
        names.append(m[1] or "")
        n += 1
        return STYLES[style](n - 1)

    return _PARTS.sub(put, sql), [x for x in names if x]


def bound(sql: str, values: dict, style: str = "qmark") -> tuple[str, Sequence]:
    """A statement with `${name}` placeholders and the values to run it with; a missing value raises."""
    text, names = named(sql, style)
    if lacking := [x for x in names if x not in values]:
        raise KeyError(f"no value for {', '.join(lacking)}")
    return text, [values[x] for x in names]
