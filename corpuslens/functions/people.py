"""People in metadata: identities, keyed pseudonyms, written forms of names, redaction. Keys are 32 bytes at least and never stored."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.metadata import check_digit, values
from corpuslens.functions.text import fold_key


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string, as lowercase hex: two SHA-256 over literal pads, inside the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def pseudonym(identity: Column, key: bytes, prefix: str) -> Column:
    """The prefix and ten hex digits of the keyed hash of prefix, NUL, identity; null for no identity."""
    if len(key) < 32:
        raise ValueError("a key has 32 bytes at least")
    return F.concat(F.lit(prefix), F.substring(hmac_sha256(key, F.concat(F.lit(f"{prefix}\0"), identity)), 1, 10))


def orcid(text: Column) -> Column:
    """The bare form 0000-0000-0000-000X of an identifier whose check digit is right; else null."""
    bare = F.upper(F.regexp_extract(F.trim(text), r"(?i)^(?:https?://(?:www\.)?orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dX])/?$", 1))
    digits = F.replace(F.substring(bare, 1, 18), F.lit("-"), F.lit(""))
    return F.when((bare != "") & (check_digit(digits) == F.substring(bare, 19, 1)), bare)


def name_key(name: Column) -> Column:
    """Folded, with one form of the comma: ``family, given``."""
    return F.trim(F.regexp_replace(fold_key(name), r"\s*,\s*", ", "))


def identity(orcid_text: Column, name: Column) -> Column:
    """A valid identifier wins over the name."""
    return F.coalesce(orcid(orcid_text), F.nullif(name_key(name), F.lit("")))


def author_codes(identities: Column, key: bytes, prefix: str) -> Column:
    """Distinct pseudonyms in order of first appearance."""
    return F.array_distinct(F.transform(values(identities), lambda x: pseudonym(x, key, prefix)))


def written_forms(name: Column) -> Column:
    """``Family, Given`` as it may be written: as is, given first, family alone with the first given name."""
    parts = F.split(name, r"\s*,\s*", 2)
    family, given = F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))
    first = F.split(given, r"\s+")[0]
    return F.array_distinct(F.array_compact(F.array(F.trim(name), F.concat_ws(" ", given, family), F.concat_ws(" ", family, given), F.when(given.isNotNull(), F.concat_ws(" ", first, F.split(family, r"\s+")[0])))))


def redacted(text: Column, names: list[str], mark: str = "[…]") -> Column:
    """The text without the given names: the longest first, any case, bounded by letters."""
    import re

    if not names:
        return text
    longest = "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<!\p{{L}})(?:{longest})(?!\p{{L}})", mark)
