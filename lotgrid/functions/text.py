"""Text normal forms and tag parsing, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_owner(c: Column) -> Column:
    """Upper case, other than letters and digits to one blank, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9 ]+", " "), " +", " "))


def norm_name(c: Column) -> Column:
    """Lower case, ``&`` spelled out, punctuation to one blank, trimmed; blank becomes null."""
    spelled = F.regexp_replace(F.lower(c), "&", " and ")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9 ]+", " "), " +", " ")), F.lit(""))


def key_code(c: Column) -> Column:
    """Upper case without blanks and hyphens."""
    return F.regexp_replace(F.upper(c), r"[\s\-]", "")


def first_number(c: Column) -> Column:
    """The first number in a tag, else null."""
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def to_minutes(c: Column) -> Column:
    """Minutes of HH:MM:SS; hours may exceed 24. Null where the text has no such form."""
    part = lambda i: F.try_element_at(F.split(c, ":"), F.lit(i)).try_cast("int")
    return part(1) * 60 + part(2) + part(3) / F.lit(60.0)


#: Names of query parameters that carry secrets.
SECRETS = ("key", "api_key", "apikey", "token", "access_token")


def redact(c: Column) -> Column:
    """The values of secret query parameters of a URL replaced by three stars, whatever their case."""
    out = c
    for name in SECRETS:
        out = F.regexp_replace(out, rf"(?i)(?<=[?&]{name}=)[^&\s'\"]+", "***")
    return out


#: Labels for the five times of the week and what they are called elsewhere.
DAYPARTS = {"wd_day": "weekday day|weekday daytime|wd day|wd_day", "wd_eve": "weekday evening|weekday eve|wd eve|wd_eve", "we_day": "weekend day|weekend daytime|we day|we_day", "we_eve": "weekend evening|weekend eve|we eve|we_eve", "event": "event|event night|event day"}


def daypart(c: Column) -> Column:
    """The label of a time of the week, however spelled; null for any other text."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s\-]+", " "))
    return F.coalesce(*[F.when(plain.isin(*names.split("|")), F.lit(label)) for label, names in DAYPARTS.items()])


#: State codes of the federal numbering, in its order (gaps are numbers not in use).
STATES = "AL AK - AZ AR CA - CO CT DE DC FL GA - HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA - RI SC SD TN TX UT VT VA - WA WV WI WY".split()


def state_abbr(fips: Column) -> Column:
    """The two letters of a state by its number, with or without the leading zero; null for any other."""
    return F.nullif(F.try_element_at(F.array(*map(F.lit, STATES)), F.when(fips.try_cast("int") > 0, fips.try_cast("int"))), F.lit("-"))


def why(parts: list[tuple[Column, Column]]) -> Column:
    """The texts whose conditions hold, joined by semicolons."""
    return F.concat_ws("; ", *[F.when(cond, said) for cond, said in parts])


def tags(c: Column) -> Column:
    """A JSON object as a map of texts; an empty map where it is none."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def numbers(c: Column) -> Column:
    """The sorted whole numbers of a text."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))


def _ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; the subsequence's table is one bit row per letter."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens alone and with either rest, as sorted token sets."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left, right = (f"{common} {' '.join(sorted(r))}".strip() for r in (x - y, y - x))
    if common and (not x - y or not y - x):
        return 1.0
    scores = [_ratio(left, right)]
    if common:
        scores += [_ratio(common, left), _ratio(common, right)]
    return max(scores)


def similarity(a: Column, b: Column) -> Column:
    """Token-set similarity of two normal names; 0 if one is missing or their numbers differ."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) if p and q else 0.0 for p, q in zip(x, y)])

    same = a.isNotNull() & b.isNotNull() & (numbers(a) == numbers(b))
    return F.when(same, score(a, b)).otherwise(0.0)
