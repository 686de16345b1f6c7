"""What every match of a regular expression must contain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
# Escapes that stand for a kind of character or place, and take no argument.
KINDS = set("dDwWsSbBhHvVRnrtfaeAzZG")
OPENINGS = ("(?:", "(?=", "(?!", "(?<")


def literal_runs(pattern: str) -> list[list[str]] | None:
    """Per branch of the pattern, the runs of ASCII letters that all its matches contain,
    in lower case; None if the pattern holds something not looked into here.

    Only what stands outside groups and classes counts. A character that may be missing
    is taken off the run before it.
    """
    branches: list[list[str]] = [[]]
    run: list[str] = []
    i, depth = 0, 0

    def close() -> None:
        if run:
            branches[-1].append("".join(run))
            run.clear()

    while i < len(pattern):
        c = pattern[i]
        step = 1
        if c == "\\":
            follows = pattern[i + 1 : i + 2]
            step = 2
            if follows in ("p", "P"):
                if pattern[i + 2 : i + 3] == "{":
                    end = pattern.find("}", i)
                    if end < 0:
                        return None
                    step = end + 1 - i
                else:
                    step = 3
                if not depth:
                    close()
            elif not follows or (follows.isalnum() and follows not in KINDS):
                return None
            elif not depth:
                if follows.isalnum() or not follows.isascii():
                    close()
                else:
                    run.append(follows)
        elif c == "[":
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                return None
            at, inner = i, 0
            while True:
                if at >= len(pattern):
                    return None
                if pattern[at] == "\\":
                    # A quoted stretch could hold brackets of its own.
                    if pattern[at + 1 : at + 2] in ("Q", ""):
                        return None
                    at += 2
                    continue
                inner += {"[": 1, "]": -1}.get(pattern[at], 0)
                at += 1
                if not inner:
                    break
            step = at - i
            if not depth:
                close()
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and not pattern.startswith(OPENINGS, i):
                return None
            if not depth:
                close()
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif depth:
            pass
        elif c == "|":
            close()
            branches.append([])
        elif c in "?*{":
            if run:
                run.pop()
            close()
            if c == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return None
                step = end + 1 - i
        elif c in "+.^$" or not c.isascii():
            close()
        else:
            run.append(c.lower())
        i += step
    close()
    return None if depth else branches


def grams(pattern: str | None) -> list[list[str]]:
    """Per branch, the groups of ``GRAM`` letters a match contains; shorter ones if there
    is no run as long, and the empty group if there is nothing to go by."""
    branches = literal_runs(pattern or "")
    if branches is None:
        return [[""]]
    out = []
    for runs in branches:
        n = min(GRAM, max((len(r) for r in runs), default=0))
        out.append(sorted({r[i : i + n] for r in runs for i in range(len(r) - n + 1)}) if n else [""])
    return out


def required_grams(pattern_col: str) -> Column:
    """``grams`` as a column; it runs over the patterns of a lexicon, not over texts."""

    @F.pandas_udf("array<array<string>>")
    def of_patterns(patterns: pd.Series) -> pd.Series:
        return patterns.map(grams)

    return of_patterns(F.col(pattern_col))
