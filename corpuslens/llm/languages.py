"""Language ID by mixture inference.

Counts of hashed letter trigrams are learned for each language over all labelled documents. A document is a mixture: a trigram has
probability sum of p(language) p(trigram | language), and expectation-maximisation estimates the proportions over all learned languages.
Starting from the language that explains the document best alone, each other, the greatest proportion first, joins the set if the likelihood
gains more than a penalty per language; then each whose loss costs no more than the penalty leaves. The prediction is the greatest proportion
within the chosen set. Documents whose likelihood can't gain so much from any set (a bound of the concave likelihood says so) are not tried.

How much of a document is in learned languages at all (``known``) is the proportion, by the same estimation, of its mixture against trigrams
that are all equally likely: about 1 for learned languages, less for others by how near they are, about 0 for random letters.

Counts cover every learned document; a model is (languages x BUCKETS) numbers, whatever the corpus: each distinct ``lang`` value is a language,
and the driver holds 128 KB for each. Documents are not cut.

Defined results: null text, and text without a letter (combining marks alone are none), is ``und`` with score 0; ids are read as bigint; a document without a learned language at hand (nothing to learn from) is
``und`` too; null and repeated ids are documents like any other; rows with null id or null lang teach nothing; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import lean, small_batches, trim

UNKNOWN = "und"
BITS = 14
BUCKETS = 1 << BITS
#: Added to each count; trigrams of doubt in a share; EM steps; log-likelihood that a further language must gain, per log of trigrams.
SMOOTH, DOUBT, STEPS, PENALTY = 0.5, 3, 10, 4.0
#: Characters worked on at once, with no more than FEW languages; fewer with more.
SLICE_CHARS, FEW = 1 << 18, 4


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which characters are letters, and which letters or marks, that go on a letter's word."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    return kinds == ord("L"), (kinds == ord("L")) | (kinds == ord("M"))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts that have a letter, and the text of each. Marks count as letters there; runs of other characters count as one
    space; texts start and end with one."""
    lowered = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lowered])
    real, either = _letters()
    letter = either[points] & (np.bincount(doc[real[points]], minlength=len(texts)) > 0)[doc]
    keep = letter.copy()
    if len(keep):
        keep[0] = True
        keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    points, doc, letter = np.where(letter, points, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    good = letter[1:-1] & (doc[2:] == doc[:-2])
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[good], doc[:-2][good]


def _chunks(texts: list[str], languages: int = FEW) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_CHARS * FEW // max(FEW, languages):
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("t").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in _chunks(texts):
            grams, doc = trigrams(texts[lo:hi])
            names = sorted(set(langs[lo:hi]))
            code = np.array([names.index(x) for x in langs[lo:hi]], np.int64)
            found = np.bincount(code[doc] * BUCKETS + grams, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names, found, strict=True):
                total[name] = total.get(name, 0) + row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])


@dataclass(frozen=True)
class Languages:
    """Names in code point order, and log p(trigram | language)."""

    names: tuple[str, ...]
    log_p: np.ndarray


def learn(docs: DataFrame) -> Languages:
    """A model of the labelled documents (text, lang) given."""
    small_batches(docs.sparkSession)
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").alias("t"), "lang")
    counted = rows.mapInArrow(lean(_counts), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(counted["lang"].unique()))
    table = np.zeros((len(names), BUCKETS))
    if names:
        table[pd.Categorical(counted["lang"], categories=names).codes, counted["bucket"]] = counted["n"]
    table += SMOOTH
    return Languages(names, np.log(table / table.sum(axis=1, keepdims=True)))


def _mixture(p: np.ndarray, weight: np.ndarray, doc: np.ndarray, heads: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions for each document over its languages in ``use``, and log-likelihood. p: (entries, languages)."""
    theta = use / use.sum(axis=1, keepdims=True)
    total = np.add.reduceat(weight, heads)[:, None]
    for _ in range(STEPS):
        part = p * theta[doc]
        part *= (weight / part.sum(axis=1))[:, None]
        theta = np.add.reduceat(part, heads, axis=0) / total
    return theta, np.add.reduceat(weight * np.log((p * theta[doc]).sum(axis=1)), heads)


def _refit(p: np.ndarray, weight: np.ndarray, doc: np.ndarray, pick: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_mixture`` of the documents at ``pick`` (ascending) alone, over the columns that their sets need."""
    rows = np.flatnonzero(np.isin(doc, pick))
    sub = np.searchsorted(pick, doc[rows])
    cols = np.argsort(-use, axis=1, kind="stable")[:, : int(use.sum(axis=1).max())]
    small, likely = _mixture(p[rows[:, None], cols[sub]], weight[rows], sub, np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]]), np.take_along_axis(use, cols, axis=1))
    theta = np.zeros(use.shape)
    np.put_along_axis(theta, cols, small, axis=1)
    return theta, likely


def _sets(p: np.ndarray, weight: np.ndarray, doc: np.ndarray, heads: np.ndarray, alone: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions for each document over its set of languages of penalised likelihood."""
    k, every = p.shape[1], np.arange(len(heads))
    theta, likely = _mixture(p, weight, doc, heads, np.ones((len(heads), k)))
    # no mixture of any languages is likelier than this
    mix = (p * theta[doc]).sum(axis=1)
    bound = likely + np.add.reduceat(p * (weight / mix)[:, None], heads, axis=0).max(axis=1) - n
    order = np.argsort(-theta, axis=1, kind="stable")
    need = PENALTY * np.log(n + 1)
    best = alone.argmax(axis=1)
    now, result = alone[every, best], np.zeros((len(heads), k))
    result[every, best] = 1
    chosen = result.copy()
    for j in range(k):
        pick = np.flatnonzero((chosen[every, order[:, j]] == 0) & (bound - now > need))
        if len(pick):
            use = chosen[pick]
            use[np.arange(len(pick)), order[pick, j]] = 1
            mixed, likely = _refit(p, weight, doc, pick, use)
            joins = likely - now[pick] > need[pick]
            chosen[pick[joins]], result[pick[joins]], now[pick[joins]] = use[joins], mixed[joins], likely[joins]
    order = np.argsort(result, axis=1, kind="stable")
    for j in range(k):
        # a set of two has gained more than the penalty over either alone
        pick = np.flatnonzero((chosen[every, order[:, j]] == 1) & (chosen.sum(axis=1) > 2))
        if len(pick):
            use = chosen[pick]
            use[np.arange(len(pick)), order[pick, j]] = 0
            mixed, likely = _refit(p, weight, doc, pick, use)
            leaves = now[pick] - likely <= need[pick]
            chosen[pick[leaves]], result[pick[leaves]], now[pick[leaves]] = use[leaves], mixed[leaves], likely[leaves]
    return result


def infer(model: Languages, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Predicted languages and scores."""
    return _infer(model, texts, False)[:2]


def _infer(model: Languages, texts: list[str], weigh: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted languages, scores and, if asked for, the shares known."""
    out, score, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    grams, doc = trigrams(texts)
    if not len(grams) or not model.names:
        return out, score, known
    pairs = np.sort(doc << BITS | grams)
    head = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    weight = np.diff(np.r_[head, len(pairs)]).astype(float)
    doc, grams = pairs[head] >> BITS, pairs[head] & (BUCKETS - 1)
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    which, doc = doc[heads], np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    log_p = model.log_p.T[grams]
    alone = np.add.reduceat(log_p * weight[:, None], heads, axis=0)
    n = np.add.reduceat(weight, heads)
    p = np.exp(log_p)
    result = _sets(p, weight, doc, heads, alone, n)
    if weigh:
        both = np.stack([(p * result[doc]).sum(axis=1), np.full(len(doc), 1 / BUCKETS)], axis=1)
        known[which] = _mixture(both, weight, doc, heads, np.ones((len(heads), 2)))[0][:, 0]
    top = result.argmax(axis=1)
    share = result[np.arange(len(heads)), top]
    # a few trigrams don't make a proportion certain
    share = (n * share + 1) / (n + min(DOUBT, len(model.names)))
    for d, i, s in zip(which.tolist(), top.tolist(), share.tolist(), strict=True):
        out[d], score[d] = model.names[i], s
    return out, score, known


def _predict(model: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [], []
            for lo, hi in _chunks(texts, len(model.names)):
                n, s = infer(model, texts[lo:hi])
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return run


def told(model: Languages):
    """A column function: text to a struct of lang_pred, score and known, the share that the learned languages explain (0 to 1)."""

    @F.pandas_udf("lang_pred string, score double, known double")
    def run(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        parts = [_infer(model, texts[lo:hi], True) for lo, hi in _chunks(texts, len(model.names))]
        trim()
        join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
        return pd.DataFrame({"lang_pred": [n for names, _, _ in parts for n in names], "score": join(1), "known": join(2)})

    return run


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the share of the language in the document, 0 to 1)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_predict(model)), "doc_id bigint, lang_pred string, score double")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as held out nowhere."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1))
