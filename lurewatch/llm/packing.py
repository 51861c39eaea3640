"""Packing by concatenate and cut.

All documents, tokenized and ended by an end id, form one stream that is cut
into sequences of a fixed length; only the last sequence is short.  Two passes:
the first tokenizes each input partition and keeps every document's place in
it; prefix sums over the partitions' totals then give every partition its place
in the stream, and the second pass cuts documents at the sequence borders,
giving one record per piece.  Nothing but one number per partition is shuffled.
The stream's order is that of the input's partitions, fixed by the first
pass's table.

A word's ids don't depend on its neighbours (the tokenizer's normalizer and
splitter never look across ASCII white space), so words are tokenized once and
remembered, up to a bound.

Defined cases: null and empty texts consist of the end id; null and repeated
ids are packed as any others; long documents span many sequences; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_path
from .textarrays import pieces

LENGTH, END = 2048, 1
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, that a Python worker remembers: a part is tokenized, a word is put together of parts.
MOST_WORDS, MOST_PARTS = 350_000, 700_000
#: Parts tokenized in one call.
TOGETHER = 512
#: ASCII signs other than the apostrophe: the splitter cuts between Latin letters and these, and lower case is per letter.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Recent(dict):
    """A dict bounded by ``most``: when its half is full it is set aside, and what is asked for again moves back."""

    def __init__(self, most: int):
        self.most, self.old = most // 2, {}

    def recall(self, keys: set) -> set:
        """The ``keys`` not known; room is made for them before any is added."""
        if len(self) + len(keys) > self.most:
            self.old = dict(self)
            self.clear()
        missing = keys - self.keys()
        again = missing & self.old.keys()
        self.update((k, self.old[k]) for k in again)
        return missing - again


class _Words:
    """Ids of words, given as bytes, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.ends = np.isin(np.arange(self.tokenizer.get_vocab_size()), list(ends))
        self.words, self.parts = _Recent(MOST_WORDS), _Recent(MOST_PARTS)
        # a tokenizer for which the rules of ``_cut`` and of word ends don't hold gets each word as it is
        self.plain = True
        probe = ["Lorem", "ipsum", "DOLOR,", "naïve;", "Ünder(", "x!?"]
        self.plain = all(self._single(x) == b"".join(map(self._single, self._cut(x))) for x in probe)
        self.ended = bool(ends) and self._joined(["lorem", "ipsum", "naïve"]) == [self._single(x) for x in ("lorem", "ipsum", "naïve")]

    def _single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of letters only, tokenized as one text and cut behind the tokens that end a word."""
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(parts):
            return list(map(self._single, parts))
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _cut(self, text: str) -> tuple[str, str]:
        """Lower-cased letters and the signs behind them; a word of another form is kept whole, in the second place."""
        base = text.rstrip(_SIGNS)
        if self.plain and base.isalpha() and (base.isascii() or _LATIN.fullmatch(base)):
            return base.lower(), text[len(base) :]
        return "", text

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A dict that knows all ``words``."""
        new, parts = list(self.words.recall(words)), self.parts
        if not new:
            return self.words
        letters, others = [], []
        for text in b"\n".join(new).decode().split("\n"):
            a, b = self._cut(text)
            letters.append(a)
            others.append(b)
        wanted, letter = parts.recall({*letters, *others, ""}), set(letters) if self.ended else set()
        joined = sorted(wanted & letter - {""})
        for i in range(0, len(joined), TOGETHER):
            some = joined[i : i + TOGETHER]
            parts.update(zip(some, self._joined(some), strict=True))
        for part in wanted - letter | (wanted & {""}):
            parts[part] = self._single(part)
        known = parts.__getitem__
        self.words.update(zip(new, map(operator.add, map(known, letters), map(known, others)), strict=True))
        return self.words


_words: dict[str, _Words] = {}


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of texts, without the end id."""
    if path not in _words:
        _words[path] = _Words(path)
    split = [(t or "").encode().split() for t in texts]
    known = _words[path].learn(set().union(*split))
    return [b"".join(map(known.__getitem__, words)) for words in split]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """First pass, as a written table: part, start (in the part), doc_id, n, ids."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            ids = [x + end for x in encode(batch.column("text").to_pylist(), path)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int64()), pa.array(start), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], ["part", "start", "doc_id", "n", "ids"])

    schema = "part long, start long, doc_id long, n long, ids binary"
    out = work_path(docs.sparkSession, "tokens")
    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(schema).parquet(out)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, *, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues (and ids, little-endian 32-bit)."""
    tokens = tokenized(docs, path or public_tokenizers.path(VOCABULARY))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # one row per input partition, so the broadcast is bounded by their number
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            count = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), count)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + (at // length)[doc]
            lo = np.maximum(sequence * length, at[doc])
            hi = np.minimum((sequence + 1) * length, (at + n)[doc])
            start = lo - at[doc]
            views = [memoryview(x) for x in batch.column("ids").to_pylist()]
            parts = [views[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), start.tolist(), (hi - at[doc]).tolist(), strict=True)]
            crc = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(hi - lo), crc, pa.array(n[doc]), pa.array(sequence), pa.array(lo - sequence * length), pa.array(hi < (at + n)[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues"]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean"
    return placed.mapInArrow(cut, schema + ", ids binary" * with_ids)


def padded_length(used: int, length: int = LENGTH) -> int:
    """What a sequence with ``used`` tokens is padded to: ``length``, but a power of two stays."""
    return used if used & (used - 1) == 0 else length
