"""The token estimate in plain Python (for folds over a document), and cuts by it."""

from __future__ import annotations

import math

LETTERS, DIGITS, SYMBOLS = 3.6, 2.0, 0.8


_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_DIGITS, _FREE = b"0123456789", b" \t"


def classes(s: str) -> tuple[int, int, int]:
    """Letters (whatever is beyond ASCII is one), digits, symbols; counted in C."""
    a = s.encode("ascii", "ignore")
    letters, digits, free = (len(a) - len(a.translate(None, c)) for c in (_LETTERS, _DIGITS, _FREE))
    return letters + len(s) - len(a), digits, len(a) - letters - digits - free


def estimate(s: str) -> int:
    letters, digits, symbols = classes(s)
    return math.ceil(letters / LETTERS + digits / DIGITS + symbols * SYMBOLS)


def _longest(n: int, fits) -> int:
    """The largest k in 0..n that fits (fits never turns true again)."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def head(s: str, most: int) -> str:
    """The start of s within `most` tokens, back to a space if one lies in the last fifth."""
    if estimate(s) <= most:
        return s
    n = _longest(len(s), lambda k: estimate(s[:k]) <= most)
    space = s[:n].rfind(" ")
    return s[: space if space > n * 0.8 else n].rstrip()


def tail(s: str, most: int) -> str:
    """The end of s within `most` tokens, on from a space if one lies in the first fifth."""
    if estimate(s) <= most:
        return s
    n = _longest(len(s), lambda k: estimate(s[len(s) - k :]) <= most)
    cut = s[len(s) - n :]
    space = cut.find(" ")
    return (cut[space + 1 :] if 0 <= space < len(cut) * 0.2 else cut).lstrip()
