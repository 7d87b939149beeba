"""Normal forms of parcel keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "０１２３４５６７８９"
_PLAIN = "0123456789"
_D = "[0-9OIL]"
_SEP = r"[ .,_/\-\x{2010}-\x{2015}\x{2212}]"


_STEPS = (
    (r"[\s\x{00a0}\x{3000}]+", " "),
    (r"^ | $", ""),
    (r"^ASM:.*$|^[^0-9]*$", ""),
    (rf"^(?:PID|PARCEL|PCL|APN)(?: ?(?:ID|NO|NUMBER))?[ .:#]*(?={_D})", ""),
    (rf"^({_D}{{1,3}}){_SEP}+({_D}{{1,6}})(?:{_SEP}+[0O]{{2}})?$", "~00$1-00000$2"),
    (rf"^({_D}{{7,9}})(?:[0O]{{2}})?$", "~00$1"),
    (rf"^~{_D}*?({_D}{{3}})-{_D}*?({_D}{{6}})$", "~$1$2"),
    (rf"^~{_D}*?({_D}{{9}})$", "~$1"),
    (r"[^0-9A-Z]+", ""),
)


def parcel_key(raw: Column) -> Column:
    """What a parcel id means, however it is written: nine digits, or null where it names nothing.

    Full-width digits, the letter O for zero, a PID prefix, any separator, dropped leading zeros of
    either block and a trailing unit ``00`` are all the same parcel. Null, blank, texts without a
    digit (words for "none") and ids of assembled sites (``ASM:``) give null. Any other text is its
    own key without its separators, so it still matches its own repeats. Every step refers to the
    one before it once, so the expression stays linear however often it is inlined; the plain way of
    writing an id, which most rows use, skips them all.
    """
    out = F.upper(F.translate(raw, _WIDE, _PLAIN))
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(raw.rlike(r"^[0-9]{3}-[0-9]{6}$"), F.translate(raw, "-", "")).otherwise(F.nullif(F.translate(out, "OIL", "011"), F.lit("")))


def parcel_key_sql(column: str) -> str:
    """The same normal form as DuckDB SQL (its patterns have no lookahead and write groups as \\1)."""
    out = f"upper(translate({column}, '{_WIDE}', '{_PLAIN}'))"
    for pattern, by in _STEPS:
        if "(?=" in pattern:
            pattern, by = pattern.replace("(?=", "("), r"\1"
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"nullif(translate({out}, 'OIL', '011'), '')"
