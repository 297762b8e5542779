"""Whether a text is one JSON object or list, told from pieces that are looked at apart.

What a piece does to bracket depth depends on whether it begins inside a string, which only the pieces before it
know. So each piece is summarised for every state that it may begin in, and the summaries are put together in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Outside of strings, inside, and inside after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
_OPEN = re.compile(rb'["{}\[\]]')
_STRING = re.compile(rb'["\\]')
_DEEPER = {b"{": 1, b"[": 1, b"}": -1, b"]": -1}


def shape(piece: bytes, state: int) -> tuple[int, int, int | None, bool, bool]:
    """``(state after it, depth after it, lowest depth before its last bracket, has brackets, nothing after the last)``.

    Depths count from the piece's beginning.
    """
    depth, low, seen, at, last = 0, None, False, 0, 0
    while at <= len(piece):
        if state == ESCAPED:
            if at == len(piece):
                break
            at, state = at + 1, INSIDE
        found = (_OPEN if state == OUTSIDE else _STRING).search(piece, at)
        if not found:
            break
        at = found.end()
        if state == INSIDE:
            state = OUTSIDE if found[0] == b'"' else ESCAPED
        elif found[0] == b'"':
            state = INSIDE
        else:
            if seen:
                low = depth if low is None else min(low, depth)
            depth, seen, last = depth + _DEEPER[found[0]], True, at
    return state, depth, low, seen, state == OUTSIDE and not piece[last:].strip()


def shapes(piece: bytes, first: bool) -> list[tuple]:
    """The summaries of a piece for every state; a first piece begins outside. Blank pieces have none."""
    return [shape(piece, state) for state in ((OUTSIDE,) if first else (OUTSIDE, INSIDE, ESCAPED))]


def one_value(pieces: Iterable[tuple[bool, list[tuple]]]) -> bool:
    """Whether the brackets of all pieces, ``(blank, shapes)`` in order, open once at the start and close at the end.

    A blank piece counts only inside a string.
    """
    state, depth, ended = OUTSIDE, 0, False
    for blank, found in pieces:
        if blank and state == OUTSIDE:
            continue
        if ended:  # something follows the bracket that closed the value
            return False
        after, change, low, seen, last = found[state]
        if low is not None and depth + low < 1:
            return False
        state, depth = after, depth + change
        if seen and depth < 1:
            if depth or not last:
                return False
            ended = True
    return ended and state == OUTSIDE
