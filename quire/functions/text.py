"""Text rules of publications, as pure functions and as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming takes off both ends: Unicode white space and the byte order mark. Fixed values.
TRIMMED = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)


def trim(s: str) -> str:
    return s.strip(TRIMMED)


def ascii_lower(s: str) -> str:
    """Lower case of A-Z only: keywords of style sheets and markup."""
    return s.translate(_ASCII)


def utf16_len(s: str) -> int:
    """Length in UTF-16 units, in which limits and offsets are given."""
    return len(s) + sum(ord(c) > 0xFFFF for c in s)


def sample(s: str, limit: int = 64) -> str:
    """The beginning of s, at most limit UTF-16 units, no character split."""
    out, used = [], 0
    for c in s:
        used += 1 + (ord(c) > 0xFFFF)
        if used > limit:
            break
        out.append(c)
    return "".join(out)


def collapse_html(s: str) -> str:
    """Runs of HTML white space become one space; a no-break space is content."""
    return re.sub("[ \t\n\r\f]+", " ", s).strip(" ")


def collapse_xml(s: str) -> str:
    return re.sub("[ \t\n\r]+", " ", s).strip(" ")


def fnv1a64(data: bytes) -> str:
    """FNV-1a of 64 bits as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def tokens(s: str | None) -> list[str]:
    """Distinct white-space separated tokens in order."""
    return list(dict.fromkeys((s or "").split()))


# As columns: all stay in the JVM.


def ascii_lower_col(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def collapse_html_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "), "^ | $", "")


def tokens_col(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def utf16_len_col(c: Column) -> Column:
    """Characters outside the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))


def entry_name_col(c: Column) -> Column:
    """Entry names: backslashes turned, leading '/' and './' taken off."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\.?/)+", "")


def media_type_col(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def section_kind_col(media: Column) -> Column:
    """Whether a media type can be a section: xhtml, image or unsupported."""
    xhtml = media.isin("application/xhtml+xml", "text/html", "text/x-oeb1-document")
    return F.when(xhtml, "xhtml").when(media.startswith("image/"), "image").otherwise("unsupported")


def finite_double_col(c: Column) -> Column:
    """A number as publications write it; null for anything else, infinities and hexadecimal included."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))
