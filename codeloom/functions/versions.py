"""Versions and constraints with three outcomes: met, not met, or unknown (None)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What named releases count as, against the numbers of plain ones.
RELEASES = {"dev": 120_000_000.0, "scm": 110_000_000.0, "cvs": 100_000_000.0, "rc": -1_000.0, "pre": -10_000.0, "beta": -100_000.0, "alpha": -1_000_000.0}

_PIECE = re.compile(r"(?:([0-9]+)|([A-Za-z]+))[._-]*", re.ASCII)
_TERM = re.compile(r"@?([<>=~!]*)\s*([A-Za-z0-9._-]+)[\s,]*", re.ASCII)


@dataclass(frozen=True)
class Version:
    """Components in order and the revision after the last dash, if any."""

    parts: tuple[float, ...]
    revision: int | None = None

    @classmethod
    def parse(cls, text: str) -> Version:
        """'1.2rc1-3': components 1, 2 and rc with 1 as a small addition, revision 3.

        A word fills the component that a following number then adds a hundred-thousandth
        to; what is neither number nor word ends the version with a component of 0.
        """
        body, revision = text.strip(), None
        if m := re.search(r"-([0-9]+)\Z", body, re.ASCII):
            body, revision = body[: m.start()], int(m[1])
        parts: list[float] = []
        word = False  # whether the last component is a word without its number
        at = 0
        while at < len(body):
            m = _PIECE.match(body, at)
            if not m:
                parts = [*(parts[:-1] if word else parts), 0.0]
                break
            at = m.end()
            if m[1] and word:
                parts[-1] += float(m[1]) / 100_000
            elif m[1]:
                parts.append(float(m[1]))
            else:
                value = RELEASES.get(m[2], ord(m[2][0]) / 1_000)
                parts = [*(parts[:-1] if word else parts), value]
            word = not m[1]
        return cls(tuple(parts), revision)

    def same(self, other: Version) -> bool:
        """Equal components, as many of them, and equal revisions where both have one."""
        return self.parts == other.parts and (None in (self.revision, other.revision) or self.revision == other.revision)

    def before(self, other: Version) -> bool:
        """Smaller at the first component that differs (missing ones are 0), else by revision where both have one."""
        for a, b in zip_longest(self.parts, other.parts, fillvalue=0.0):
            if a != b:
                return a < b
        return None not in (self.revision, other.revision) and self.revision < other.revision

    def begins(self, other: Version) -> bool:
        """Agrees with all that other names, its revision included."""
        own = (*self.parts, *[0.0] * len(other.parts))
        return own[: len(other.parts)] == other.parts and other.revision in (None, self.revision)


_MEETS = {
    "==": lambda have, want: have.same(want),
    "!=": lambda have, want: not have.same(want),
    "<": lambda have, want: have.before(want),
    ">": lambda have, want: want.before(have),
    "<=": lambda have, want: not want.before(have),
    ">=": lambda have, want: not have.before(want),
    "~>": lambda have, want: have.begins(want),
}
_MEETS |= {"": _MEETS["=="], "=": _MEETS["=="], "~=": _MEETS["!="]}


def constraints_of(text: str) -> list[tuple[str, Version]] | None:
    """(operator, version) of each part; None if any can't be read."""
    out, at = [], 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m[1] not in _MEETS:
            return None
        out.append((m[1], Version.parse(m[2])))
        at = m.end()
    return out


def satisfies(version: str | None, constraints: str | None) -> bool | None:
    """Whether a version meets all constraints. No constraint is met by any version; an unknown
    version or a constraint that can't be read leaves it unknown."""
    wanted = constraints_of((constraints or "").strip())
    if wanted == []:
        return True
    if wanted is None or version is None or not version.strip():
        return None
    have = Version.parse(version)
    return all(_MEETS[op](have, want) for op, want in wanted)


def satisfaction(version: Column, constraints: Column) -> Column:
    """satisfies() over columns, in Arrow batches."""

    @F.pandas_udf("boolean")
    def run(versions: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([satisfies(v, c) for v, c in zip(versions, wanted, strict=True)], dtype=object)

    return run(version, constraints)
