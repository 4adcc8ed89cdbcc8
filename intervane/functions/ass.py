"""Override blocks and inline tags of styled lines."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PIECES = re.compile(r"[{}]|\\[^\W\d_]*|[^{}\\]+|\\")
_INT = re.compile(r"[+-]?\d+")
#: Which arguments of a tag are times, by the number of arguments.
_TIMES = {"fad": lambda n: (0, 1) if n == 2 else (), "fade": lambda n: (3, 4, 5, 6) if n == 7 else (), "move": lambda n: (4, 5) if n >= 6 else (), "t": lambda n: (0, 1) if n >= 3 else ()}
_KARAOKE = ("k", "K", "kf", "ko")


def strip_text(text: str) -> str:
    """text without {...}, nested ones included; an open block swallows the rest, a stray } goes too."""
    if "{" not in text:
        return text
    out, depth = [], 0
    for part in re.split(r"([{}])", text):
        if part == "{":
            depth += 1
        elif part == "}":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(part)
    return "".join(out)


def away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def _arguments(text: str, at: int) -> tuple[list[str], int] | None:
    """Arguments of a bracket that opens at at, split at its own commas, and the place after it."""
    if at >= len(text) or text[at] != "(":
        return None
    depth, begin, out = 0, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, text[begin:i]], i + 1
        elif c == "," and depth == 1:
            out.append(text[begin:i])
            begin = i + 1
    return None


def scale_text(text: str, scale: float) -> str:
    """text with the times of its inline tags scaled.

    Karaoke durations are scaled as running totals, so that rounding does not add up; other times one by one. Halves round away
    from zero.
    """
    if abs(scale - 1) < 1e-9 or "\\" not in text:
        return text
    out, at, depth, total, done = [], 0, 0, 0, 0
    while at < len(text):
        m = _PIECES.match(text, at)
        piece, at = m[0], m.end()
        if piece in "{}":
            depth = depth + 1 if piece == "{" else max(0, depth - 1)
        name = piece[1:]
        if piece[0] == "\\" and depth and (name in _KARAOKE or name == "kt"):
            n = _INT.match(text, at)
            if n:
                at = n.end()
                if name == "kt":
                    piece += str(away(int(n[0]) * scale))
                else:
                    total += int(n[0])
                    new = away(total * scale)
                    piece, done = piece + str(new - done), new
        elif piece[0] == "\\" and depth and name in _TIMES:
            found = _arguments(text, at)
            if found:
                args, at = found
                which = _TIMES[name](len(args))
                if name == "t" and which and None in (_number(args[0]), _number(args[1])):
                    which = ()
                for k in which:
                    v = _number(args[k])
                    if v is not None:
                        args[k] = str(away(v * scale))
                piece += "(" + ",".join(args) + ")"
        out.append(piece)
    return "".join(out)


@F.pandas_udf(StringType())
def strip_blocks(text: pd.Series) -> pd.Series:
    return text.map(strip_text, na_action="ignore")


@F.pandas_udf(StringType())
def scale_tags(text: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else scale_text(t, s) for t, s in zip(text, scale)])


def has_karaoke(text: Column) -> Column:
    return text.rlike(r"\\[kK]")


def non_dialogue(stripped: Column) -> Column:
    """Nothing left, or only music marks, after the blocks are off."""
    plain = F.trim(F.regexp_replace(stripped, r"\\[Nnh]", " "))
    return plain.rlike(r"^[♪♫♬~ ]*$")
