"""Paths and references inside a container, as pure functions and as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import trim

_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*:")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")


def has_scheme(raw: str) -> bool:
    return _SCHEME.match(trim(raw)) is not None


def is_remote(raw: str) -> bool:
    return trim(raw).lower().startswith(("http:", "https:"))


def dirname(path: str) -> str:
    return path.rpartition("/")[0]


def stem(path: str) -> str:
    """File name without its last extension; a leading dot is no extension."""
    name = path.rpartition("/")[2]
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name


def unescape(s: str) -> str | None:
    """Percent escapes undone once; None if the bytes aren't UTF-8. A lone '%' stays."""
    try:
        return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "surrogatepass")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def collapse(path: str) -> str | None:
    """The path without '.', '..' and empty segments; None if it leaves the root, is empty or has a segment no container may hold."""
    kept: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not kept:
                return None
            kept.pop()
        elif ":" in part or not part.rstrip(" ."):
            return None
        else:
            kept.append(part)
    return "/".join(kept) or None


def normalize(base: str, raw: str) -> str | None:
    """Path from the container's root of a reference made in directory base; None if it isn't a local path."""
    s = trim(raw)
    if _SCHEME.match(s) or _CONTROL.search(s):
        return None
    s = s.partition("#")[0].partition("?")[0].replace("\\", "/")
    if not s:
        return None
    return collapse(s if s.startswith("/") or not base else f"{base}/{s}")


def decode_path(path: str) -> str | None:
    """Escapes undone in each segment, unless that shows a separator or a control character."""
    parts = []
    for part in path.split("/"):
        plain = unescape(part) if "%" in part else None
        parts.append(part if plain is None or "/" in plain or _CONTROL.search(plain) else plain)
    return collapse("/".join(parts).replace("\\", "/"))


def split_fragment(raw: str) -> tuple[str, str | None]:
    path, _, fragment = raw.partition("#")
    if not fragment:
        return path, None
    plain = unescape(fragment)
    return path, fragment if plain is None or _CONTROL.search(plain) else plain


def candidates(path: str) -> list[str]:
    """Where a normalized path may be found: decoded first, then as it is."""
    plain = decode_path(path)
    return [plain, path] if plain is not None and plain != path else [path]


@F.pandas_udf(StringType())
def normalize_href(base: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else normalize(b, r) for b, r in zip(base, raw, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def decode_href(path: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else decode_path(p) for p in path], dtype=object)


def has_scheme_col(c: Column) -> Column:
    return F.trim(c).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")


def is_remote_col(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^https?:")


def dirname_col(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*)/[^/]*$", 1)


def stem_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"(?<=[\s\S])\.[^.]*$", "")


def fragment_col(c: Column) -> Column:
    return F.when(c.contains("#"), F.nullif(F.regexp_extract(c, "#(.*)$", 1), F.lit("")))


def points_to_directory_col(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[#?].*$", "").rlike(r"[/\\]$")
