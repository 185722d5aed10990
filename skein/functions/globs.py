"""Exclusion globs as regular expressions, compiled once on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _translate(glob: str) -> str:
    """A glob as a regex for the whole string; ``*`` crosses slashes.  Plain enough for Java, RE2 and Python alike."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = glob[k + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return out


def compile_globs(globs: Sequence[str]) -> tuple[str, str]:
    """Regexes for a whole path (with or without a leading slash) and for a path component.

    A component is tested against each glob without its leading and trailing ``*`` and ``/``.
    """
    whole = "|".join(_translate(g) for g in globs)
    parts = [g.strip("*/") for g in globs]
    part = "|".join(_translate(g) for g in parts)
    return rf"(?s)\A(?:{whole})\z", rf"(?s)\A(?:{part})\z"


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path is excluded by itself: as a whole, after a slash, or by one of its components."""
    if not globs:
        return F.lit(False)
    whole, part = compile_globs(globs)
    return path.rlike(whole) | F.concat(F.lit("/"), path).rlike(whole) | F.exists(F.split(path, "/"), lambda c: c.rlike(part))


def pruned(path: Column, globs: Sequence[str]) -> Column:
    """Whether a walk skips a path: it or one of the folders above it is excluded."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(prefixes, lambda p: excluded(p, globs))
