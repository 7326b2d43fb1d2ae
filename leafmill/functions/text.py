"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(_col(c), _ENDS, "")


def tidy(c) -> Column:
    """Runs of blanks become a space, empty lines one, and the ends go."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), "[ \t\f\x0b]+", " "), r"(?U)\n\s*\n+", "\n\n"))


def strip_tags(c) -> Column:
    """Last resort for text: whatever is in angle brackets goes, also around scripts."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " "))


def norm_title(c) -> Column:
    """Lower case, without white space and trailing ``/;,.``."""
    return F.lower(strip(F.regexp_replace(strip(c), "[/;,.]+$", "")))


def header_pair(line) -> Column:
    """``name`` and ``value`` of a header line, split at the first colon."""
    parts = F.split(_col(line), ":", 2)
    return F.struct(F.lower(strip(parts[0])).alias("name"), strip(F.try_element_at(parts, F.lit(2))).alias("value"))


def u32(n) -> Column:
    return F.unhex(F.lpad(F.hex(_col(n).cast("long")), 8, "0"))


def encode_text(c) -> Column:
    """A text as an encoded document: one text node."""
    raw = F.encode(_col(c), "UTF-8")
    n = F.octet_length(raw)
    size = F.when(n < 255, F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))).otherwise(F.concat(F.unhex(F.lit("FF")), u32(n)))
    return F.concat(F.unhex(F.lit("0000000103FD")), size, raw)


def inline_size(c) -> Column:
    """Bytes that a string takes inline in an encoded document."""
    n = F.octet_length(_col(c))
    return (F.when(n < 255, 2).otherwise(6) + n).cast("long")


def text_size(c) -> Column:
    """Bytes of ``encode_text``."""
    return inline_size(c) + F.lit(5)


def id_size(i) -> Column:
    """Bytes of a reference to a shared string; null stands for no value."""
    i = _col(i)
    return F.when(i.isNull() | (i < 252), 1).otherwise(3)


def escape_text(c) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(c) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def is_boilerplate(attrs) -> Column:
    """Whether attributes mark navigation and the like."""
    from .codec import SKIP_CLASSES

    def one(a):
        low = F.lower(F.coalesce(a["value"], F.lit("")))
        return ((a["name"] == "role") & (low == "navigation")) | ((a["name"] == "class") & low.rlike("|".join(SKIP_CLASSES)))

    return F.exists(_col(attrs), one)


def human_size(n) -> Column:
    n = _col(n)
    return F.when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 2), F.lit(" MB"))).when(n >= 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
