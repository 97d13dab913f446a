"""Dotted names, paths and glob patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_name(fqname: Column) -> Column:
    return F.substring_index(fqname, ".", -1)


def parent_name(fqname: Column) -> Column:
    """All but the last segment; empty for a name of one segment."""
    return F.regexp_extract(fqname, r"^(.*)[.][^.]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, root: str) -> Column:
    """The path below root; as it is if it lies elsewhere."""
    root = root.rstrip("/\\")
    return F.when(path.startswith(root), F.ltrim(F.substr(path, F.lit(len(root) + 1)), F.lit("/\\"))).otherwise(path)


def prefixes(fqname: Column) -> Column:
    """The dotted prefixes of a name, longest (the name) first."""
    parts = F.split(fqname, "[.]", -1)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))


def canonical_dist(name: Column) -> Column:
    """A distribution's name, lower-cased with one dash for each run of '-', '_' and '.'."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def is_dunder(name: Column) -> Column:
    return name.rlike("^__.+__$") & (F.length(name) > 4)


def is_test_file(path: Column) -> Column:
    base = basename(path)
    return (base.startswith("test_") & base.endswith(".py")) | base.endswith("_test.py")


def checked_regex(pattern: str) -> str:
    """The pattern; a ValueError if it can't be compiled."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return pattern


def glob_regex(pattern: str) -> str:
    """A regular expression for one component of a shell pattern (*, ?, [...])."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def path_glob_regex(pattern: str) -> str:
    """A regular expression that matches a path's last components, as a relative path pattern does; the whole path if it starts with /."""
    parts = [glob_regex(p) for p in pattern.strip("/").split("/")]
    return ("^/" if pattern.startswith("/") else "(^|/)") + "/".join(parts) + "$"
