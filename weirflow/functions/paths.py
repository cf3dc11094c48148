"""Scalar functions over paths, names, versions and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED_NAMES = ("out", "JOB_ID", "OUTPUT_COMMIT", "OUT")
_INPUT_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def ancestors(path: Column) -> Column:
    """The directories that hold a path, the outermost first, without the root: a/b/c -> [a, a/b]."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def identifier(name: Column) -> Column:
    """A repository's name as an input name."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def valid_name(name: str) -> bool:
    return bool(name) and not name.startswith(".") and "/" not in name and "\\" not in name


def valid_path(path: str) -> bool:
    return bool(path) and all(p not in ("", ".", "..") for p in path.split("/"))


def valid_input_name(name: str) -> bool:
    return bool(_INPUT_NAME.fullmatch(name)) and name not in RESERVED_NAMES


def duration_seconds(text: str) -> float:
    """``1h30m``, ``500ms``; an ``@every`` before it is allowed."""
    text = text.removeprefix("@every").strip()
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def human_size(size: Column) -> Column:
    """IEC units with two decimals; bytes without."""
    step = F.when(size < 1024, 0).otherwise(F.least(F.floor(F.log2(size.cast("double")) / 10), F.lit(4)))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB")]), step.cast("int") + 1)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).otherwise(F.concat(F.format_string("%.2f", size / F.pow(F.lit(1024.0), step)), unit))


def memory_bytes(text: Column) -> Column:
    """``1.5MiB`` in bytes; null for what isn't a size."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KMGT]?i?B)\s*$", 1), F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KMGT]?i?B)\s*$", 2)
    scale = F.create_map(*[F.lit(x) for k, e in (("B", 0), ("KiB", 1), ("MiB", 2), ("GiB", 3), ("TiB", 4)) for x in (k, 1024.0**e)], *[F.lit(x) for k, e in (("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)) for x in (k, 1000.0**e)])
    return F.when(number != "", F.try_element_at(scale, unit) * number.cast("double")).cast("long")


def version_key(version: Column) -> Column:
    """Dotted numbers as an array that compares as versions do; an optional v goes."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
