"""The two pattern dialects: globs, whose stars stop at slashes, and capture globs, whose stars don't."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

NEVER = r"(?!)"


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob. ``**`` alone matches all paths; an empty one the root only; a malformed one nothing."""
    pattern = pattern.lstrip("/")
    if pattern == "**":
        return r"(?s)\A.*\z"
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(pattern):
                return NEVER
            out.append(re.escape(pattern[k]))
        elif c == "[":
            body = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[k:])
            if not body:
                return NEVER
            items, spans = re.findall(r"\\?(.)(?:-\\?(.))?", body[2]), []
            for a, b in items:
                if a == "-" or b and b < a:
                    return NEVER
                spans.append(f"\\x{{{ord(a):x}}}" + (f"-\\x{{{ord(b):x}}}" if b else ""))
            out.append(f"[{body[1]}{''.join(spans)}]")
            k += body.end() - 1
        else:
            out.append(re.escape(c))
        k += 1
    # only the empty pattern and ** match the root
    return rf"(?s)\A{''.join(out)}\z" if not out else rf"(?s)\A(?!\z){''.join(out)}\z"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def capture_regex(pattern: str) -> str:
    """``*`` is anything, ``?`` one character, a dot itself; groups capture; all else is passed on. Anchored."""
    body = pattern.lstrip("/").replace(".", r"\.").replace("*", ".*").replace("?", ".")
    return f"^{body}$"


def capture_key(path: Column, pattern: str, selector: str) -> Column:
    """The groups that ``$1$3`` names, joined in that order; null where the path doesn't match or has no such group."""
    regex = capture_regex(pattern)
    groups = re.compile(regex).groups
    wanted = [int(n) for n in re.findall(r"\$?(\d+)", selector)]
    if any(not 0 < n <= groups for n in wanted):
        return F.lit(None).cast("string")
    key = F.concat(*[F.regexp_extract(path, regex, n) for n in wanted]) if wanted else F.lit("")
    return F.when(path.rlike(regex), key)


def scan(files: DataFrame, pattern: str) -> DataFrame:
    """files(path, ...) -> datum, path: each matching file is a datum of itself, each matching directory (or the root, datum "") one of
    its files. Files that a matching directory owns aren't datums of their own."""
    regex = glob_regex(pattern)
    owner = F.filter(F.concat(F.array(F.lit("")), ancestors(F.col("path"))), lambda p: p.rlike(regex))
    owned = files.withColumn("_owners", owner)
    inside = owned.filter(F.size("_owners") > 0).select(F.explode("_owners").alias("datum"), "path")
    alone = owned.filter((F.size("_owners") == 0) & F.col("path").rlike(regex)).select(F.col("path").alias("datum"), "path")
    return alone.unionByName(inside)
