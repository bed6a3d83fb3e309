"""Scalar functions over document metadata: multi-valued keys, partial dates, codes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def values(entries: Column | str) -> Column:
    """Non-blank strings of a multi-valued key, trimmed, in order."""
    return F.filter(F.transform(_col(entries), lambda x: F.trim(x)), lambda x: x != "")


def first(entries: Column | str) -> Column:
    return F.try_element_at(values(entries), F.lit(1))


def without_keys(metadata: Column | str, suffix: str) -> Column:
    """A map without the keys that end in ``suffix``."""
    return F.map_filter(_col(metadata), lambda k, v: ~k.endswith(suffix))


def partial_day(text: Column | str) -> Column:
    """``YYYY[-MM[-DD]]`` at the start, then the end, T or a space: the first possible day; null if there is none."""
    shape = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:$|[T ])"
    part = lambda k: F.regexp_extract(_col(text), shape, k)
    filled = F.concat(part(1), F.lit("-"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("01")), F.lit("-"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("01")))
    return F.when(part(1) != "", F.try_to_date(filled, "yyyy-MM-dd"))


def after_last(text: Column | str, mark: str = "#") -> Column:
    return F.substring_index(_col(text), mark, -1)


def short_code(text: Column | str, prefix: str, digits: int = 8) -> Column:
    """The prefix and the first hex digits of SHA-256; whether codes are unique must be checked."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(_col(text)), 256), 1, digits))


def pair_code(a: Column | str, b: Column | str, prefix: str) -> Column:
    """A code of an unordered pair."""
    both = F.concat_ws(":", F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(both, 256), 1, 8))


def check_digit(digits: Column | str) -> Column:
    """The ISO 7064 MOD 11-2 check character of a digit string."""
    total = F.aggregate(F.split(_col(digits), ""), F.lit(0), lambda s, x: ((s + x.cast("int")) * 2) % 11)
    rest = (12 - total) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def keyword(text: Column | str) -> Column:
    """White space collapsed, trailing full stops and spaces dropped, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), r"[. ]+$", ""))


#: What Unicode calls space separators.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def stripped(line: Column | str) -> Column:
    """The line without spaces of any kind (the category Zs) at its ends."""
    return F.btrim(_col(line), F.lit(SPACES))


def line_key(line: Column | str) -> Column:
    """The key by which running lines are matched: lower case (letter by letter, so that a final sigma is a sigma), digits as #, white space collapsed."""
    lower = F.lower(F.translate(_col(line), "Σİ", "σi"))
    return stripped(F.regexp_replace(F.regexp_replace(lower, r"[0-9]", "#"), r"\s+", " "))


def page_number(line: Column | str) -> Column:
    """Is the line a page number: up to three digits, a small roman numeral, ``page n`` or ``n of m``."""
    text = F.trim(_col(line))
    bare = text.rlike(r"^[-–—. ]*(?:[0-9]{1,3}|[ivxl]+)[-–—. ]*$")
    worded = text.rlike(r"(?iu)^(?:(?:p[aá]gina|p[aá]g\.?|page|seite) ?[0-9]{1,4}(?: (?:de|of|von) [0-9]{1,4})?|[0-9]{1,4} (?:de|of|von) [0-9]{1,4})$")
    return F.coalesce(bare | worded, F.lit(False))


def band(n: Column | str) -> Column:
    c = _col(n)
    return F.when(c <= 1, "1").when(c <= 5, "2-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise("21+")


def bigrams(tokens: Column | str) -> Column:
    """Adjacent pairs of tokens, joined by a space; none for fewer than two."""
    t = _col(tokens)
    n = F.size(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def tokens(text: Column | str, pattern: str = r"\p{L}+") -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))
