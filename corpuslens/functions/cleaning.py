"""Full cleaning: a text as the list of its content words, for term weights and coherence.

A text is light-cleaned, put in lower case, rid of web and mail addresses and cut into forms. Forms on a stop list go, the others become their
lemmas (a port: a lemma may be several words), which lose full stops, apostrophes and marks around them; what is then too short, without a
letter, on a stop list or a legal form of companies goes too. All but the port runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import light_clean

# Forms that are no inflected words of the language; legal forms of companies, without their dots; marks that a word loses.
KEPT = ("lean",)
LEGAL = ("sa", "saa", "sac", "scrl", "srl", "eirl")
DROPPED = ".'’´`"
LEAST = 2
ADDRESS = r"(?:https?://|www\.)[^\x00-\x20]+|[^\x00-\x20]+@[^\x00-\x20]+\.[^\x00-\x20]+"
FORM = r"[^\x00-\x20\x7f\x{a0},;:!?¡¿()\[\]{}\"«»“”…/|]+"

Lemmas = Callable[[Column], Column]


def ported(lemmatise: Callable[[list[str]], list[str]]) -> Lemmas:
    """A lemmatiser that takes the forms of a text and gives a lemma for each."""

    @F.pandas_udf("array<string>")
    def run(forms: pd.Series) -> pd.Series:
        return forms.map(lambda f: lemmatise(list(f)) if f is not None else None)

    return run


def listed(lemmas: Mapping[str, str]) -> Lemmas:
    """A lemmatiser by a small table of forms; other forms are their own lemmas."""
    pairs = [x for form, lemma in lemmas.items() for x in (F.lit(form), F.lit(lemma))]
    return lambda forms: F.transform(forms, lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)) if pairs else forms


def _among(x: Column, words: Sequence[str]) -> Column:
    return x.isin(list(words)) if words else F.lit(False)


def forms(text: Column, light: bool = True) -> Column:
    """Forms of a text in lower case, addresses left out."""
    plain = F.lower(light_clean(text) if light else text)
    return F.regexp_extract_all(F.regexp_replace(plain, ADDRESS, " "), F.lit(FORM), F.lit(0))


def bare(word: Column) -> Column:
    """Without full stops and apostrophes, and without marks at its ends."""
    return F.regexp_replace(F.translate(word, DROPPED, ""), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def content_words(text: Column, stop: Sequence[str] = (), domain: Sequence[str] = (), lemmas: Lemmas | None = None, light: bool = True) -> Column:
    """The content words of a text, in order."""
    every = {*stop, *domain}
    some = F.filter(forms(text, light), lambda x: ~_among(x, sorted(every)))
    found = lemmas(some) if lemmas is not None else some
    kept = F.zip_with(some, found, lambda form, lemma: F.when(_among(form, KEPT), form).otherwise(F.lower(lemma)))
    words = F.flatten(F.transform(kept, lambda x: F.split(F.trim(x), r"\s+")))
    return F.filter(F.transform(words, bare), lambda x: (F.length(x) >= LEAST) & F.regexp_like(x, F.lit(r"\p{L}")) & ~_among(x, sorted(every | set(LEGAL))))


def joined(words: Column) -> Column:
    """Words with single spaces between."""
    return F.array_join(words, " ")


def without(docs: DataFrame, id_col: str, words: str, stop: DataFrame) -> DataFrame:
    """Word lists without the words of a stop table (lemma) of any size: an anti-join, order kept; documents keep an empty list."""
    spread = docs.select(id_col, F.posexplode(words).alias("at", "lemma")).join(stop.select("lemma").distinct(), "lemma", "left_anti")
    again = spread.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lemma"))), lambda x: x["lemma"]).alias(words))
    return docs.drop(words).join(again, id_col, "left").withColumn(words, F.coalesce(words, F.array().cast("array<string>")))


def list_digest(words: Column) -> Column:
    """SHA-256 of the distinct words in code point order, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(words)), "\n"), 256)
