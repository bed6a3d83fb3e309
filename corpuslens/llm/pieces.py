"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

Instead of merging pairs in order of rank, the text is read left to right: one Aho-Corasick pass gives the longest piece that starts at each
place; a piece may follow another if merging their characters anew yields just these two; if no piece fits, the place is marked in
a bitfield as failed and the last piece is shortened. A text whose adjacent pieces are all compatible has one such sequence, the one
that merging yields.

No piece of the model has a space mark after another character, and some characters are in no longer piece, so the parts between are
encoded by themselves; each worker keeps the ids of parts met lately. Characters without a piece become their UTF-8 bytes.

Defined results: null text is empty and has no ids; a literal space mark decodes to a space, as in the library; null and repeated ids are
documents like any other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import lean, small_batches, text_or_empty

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Parts that a worker keeps, and the longest of them.
CACHE, CACHED_LENGTH = 320_000, 48
#: Pairs of a piece and the longest at the place after it, of which a worker keeps what follows.
NEXTS = 600_000
ROWS = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Model:
    """A merge-type model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        pieces, norm, trainer = [], {}, {}
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("not a merge-type model with byte fallback, identity normaliser and dummy prefix")
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        self.score = [float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]) for p in pieces]
        self.texts = texts
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE}
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() if k == NORMAL else b"" for t, k in zip(texts, kinds, strict=True)]
        inner = {c for t in self.ids if len(t) > 1 for c in t} - {SPACE}
        joined = re.escape("".join(sorted(inner)))
        self.parts = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{joined}{SPACE}]", re.DOTALL)
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.found = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self.merged(t) == [i]:  # others never come out of merging
                self.found.add_word(t, i)
        self.found.make_automaton()
        self.whole = all(c in self.ids for c in inner | {SPACE})
        self.size = [len(t) for t in texts]
        self.shorter = [-1] * len(texts)
        for t, i in self.ids.items():
            self.shorter[i] = self._shorter(t)
        self.nexts: dict[int, int] = {}
        #: Parts and their ids, four bytes each.
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _shorter(self, text: str) -> int:
        for n in range(len(text) - 1, 0, -1):
            if self.found.exists(text[:n]):
                return self.ids[text[:n]]
        return -1

    def merged(self, text: str) -> list[int]:
        """Ids by merging: of all adjacent pairs that make a piece the best, the leftmost of equals, again and again; -1: no piece."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Does merging the characters of both anew yield just the two?"""
        return self.merged(self.texts[a] + self.texts[b]) == [a, b]

    def _next(self, a: int, b: int) -> int:
        """The longest piece that ``b`` starts with and that may follow ``a``; -1 if there is none."""
        at = b
        while at >= 0 and not self.compatible(a, at):
            at = self.shorter[at]
        if len(self.nexts) >= NEXTS:
            self.nexts.clear()
        self.nexts[a << 20 | b] = at
        return at

    def _part(self, part: str) -> list[int]:
        """Ids of one part."""
        if len(part) == 1 and part not in self.ids:
            return [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        if not self.whole and any(c not in self.ids for c in part):
            return [i for x in self._runs(part) for i in self._part(x)]
        whole = self.ids.get(part)
        if whole is not None and self.found.exists(part):
            return [whole]  # the longest piece at its start
        size, shorter, known = self.size, self.shorter, self.nexts.get
        n = len(part)
        longest: list[int] = [-1] * n
        for end, i in self.found.iter(part):
            longest[end + 1 - size[i]] = i  # ends rise, so the last is the longest
        failed, taken = 0, []
        at, last, token = 0, -1, longest[0]
        while True:
            if last >= 0 and token >= 0:
                follows = known(last << 20 | token)
                token = self._next(last, token) if follows is None else follows
            if token >= 0:
                end = at + size[token]
                if failed >> end & 1:
                    token = shorter[token]
                    continue
                taken.append(token)
                if end == n:
                    return taken
                at, last, token = end, token, longest[end]
                continue
            # nothing fits here: shorten the piece before
            failed |= 1 << at
            token = taken.pop()
            at -= size[token]
            last = taken[-1] if taken else -1
            token = shorter[token]

    def _runs(self, part: str) -> list[str]:
        """The part cut around characters that have no piece."""
        out, run = [], ""
        for c in part:
            if c in self.ids:
                run += c
            else:
                out += [run] * bool(run) + [c]
                run = ""
        return out + [run] * bool(run)

    def _missing(self, part: str) -> bytes:
        """Ids of a part that is not among those met lately, which are kept in two generations."""
        ids = self.before.get(part)
        if ids is None:
            ids = array("i", self._part(part)).tobytes()
        if len(part) <= CACHED_LENGTH:
            if len(self.kept) >= CACHE:
                self.before, self.kept = self.kept.copy(), self.kept
                self.kept.clear()
            self.kept[part] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            get, missing = self.kept.get, self._missing
            out.frombytes(b"".join([get(part) or missing(part) for part in self.parts.findall(SPACE + text.replace(" ", SPACE))]))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if len(ids) and self.texts[ids[0]].startswith(SPACE) else text


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


def _run(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                batch = big.slice(lo, ROWS)
                ids = [np.frombuffer(model.encode(t), np.int32) for t in batch.column("t").to_pylist()]
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                out = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decode:
                    out.append(pa.array([model.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", *["decoded"] * decode])

    return run


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """One row per document: doc_id, ids; and decoded, the text made of the ids, if asked for."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    return rows.mapInArrow(lean(_run(path, decode)), "doc_id bigint, ids array<int>" + ", decoded string" * decode)


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
