"""Independent models of text rules, written for the tests only, and random values from small grammars."""

from __future__ import annotations

from fractions import Fraction

BLANKS = " \t\n\f\r"


def disposition(value: str) -> str | None:
    """By trying all ways to read ``filename``, blanks, ``=``, blanks, a quote or none, and a name; the first that works, greedy."""
    low = value.lower()
    for at in range(len(value)):
        if not low.startswith("filename", at):
            continue
        k = at + len("filename")
        while k < len(value) and value[k] in BLANKS:
            k += 1
        if k == len(value) or value[k] != "=":
            continue
        first = k = k + 1
        while k < len(value) and value[k] in BLANKS:
            k += 1
        for start in range(k, first - 1, -1):
            for begin in (start + 1, start) if value[start : start + 1] == '"' else (start,):
                end = begin
                while end < len(value) and value[end] not in '";':
                    end += 1
                if end > begin:
                    return value[begin:end]
    return None


def css_address(token: str) -> str | None:
    """By trying all ways to read ``url``, ``(``, a quote or none, an address without quotes, a quote or none, ``)``."""
    for at in range(len(token)):
        if not token.startswith("url", at):
            continue
        k = _blanks(token, at + 3)
        if token[k : k + 1] != "(":
            continue
        last = _blanks(token, k + 1)
        for start in range(last, k, -1):
            for begin in (start + 1, start) if token[start : start + 1] in ("'", '"', "`") else (start,):
                end = begin
                while end < len(token) and token[end] not in "'\"`":
                    end += 1
                for stop in range(end, begin - 1, -1):
                    after = stop + 1 if token[stop : stop + 1] in ("'", '"', "`") else stop
                    if any(token[_blanks(token, x) : _blanks(token, x) + 1] == ")" for x in {after, stop}):
                        return token[begin:stop]
    return None


def _blanks(text: str, k: int) -> int:
    while k < len(text) and text[k] in BLANKS:
        k += 1
    return k


def rate(whole: int, digits: str, unit: str) -> int:
    """Bytes of a rate written as ``whole.digits`` and a unit; the fraction is cut before the unit counts."""
    number = Fraction(f"{whole}.{digits or 0}")
    return int(number) * {"k": 10**3, "M": 10**6, "": 1, " ": 1}.get(unit, 0)
