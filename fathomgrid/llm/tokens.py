"""Token counts by overlap resynchronisation, and the exact memoised encoder that packing uses too."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes

#: Entries of each of a worker's two memos: the full one becomes the old one, which changes no result.
MEMO = 200_000
#: A longer text is encoded in pieces that end at white space.
PIECE_BYTES = 1 << 20
SPACES = re.compile(rb"[ \t\n\r]")
_encoders: dict[str, "Encoder"] = {}


class Memo(dict):
    """Ids (little-endian 32 bits each) of white-space-parted chunks, found by an encoder when first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, chunk: bytes) -> bytes:
        got = self[chunk] = self.find(chunk)
        return got


class Encoder:
    """Exact ids of texts under a tokenizer that drops white space and lower-cases, from ids of white-space-parted chunks.

    Its normaliser acts within chunks, no pre-token crosses white space and its merges stay inside pre-tokens,
    so a text's ids are its chunks' ids in order. A tokenizer that doesn't pass a trial of this is refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters: dict[int, str] = {}
        normal = self.tok.normalizer
        if normal is None or normal.normalize_str("Aa") != "aa" or self._library("Ab  cD\n\tab") != self._library("ab") + self._library("cd") + self._library("ab"):
            raise ValueError(f"{path} doesn't lower-case or doesn't drop white space")
        for c in map(chr, range(0x41, 0x250)):
            small = normal.normalize_str(c)
            if c.isalpha() and len(small) == 1 and small.isalpha():
                parts = self.tok.pre_tokenizer.pre_tokenize_str(small)
                if len(parts) == 1:
                    self.letters[ord(c)] = parts[0][0]
        self.plain = re.compile(f"[{''.join(map(chr, self.letters))}]+").fullmatch
        self.memo, self.old = Memo(self._found), {}

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _found(self, chunk: bytes) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            text = chunk.decode()
            if self.plain(text):  # one pre-token, normalised and mapped letter by letter
                got = array("I", [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes()
            elif chunk[-1:] in (b".", b",") and len(chunk) > 1 and ord(text[-2]) in self.letters:
                got = self.memo[chunk[:-1]] + self.memo[chunk[-1:]]
            else:
                got = self._library(text)
        return got

    def ids(self, text: bytes) -> bytes:
        """The text's ids, as little-endian 32 bits each."""
        if len(text) > PIECE_BYTES:
            parts, at = [], 0
            while at < len(text):
                end = SPACES.search(text, at + PIECE_BYTES)
                parts.append(self._piece(text[at : end.start() if end else len(text)]))
                at = end.start() if end else len(text)
            return b"".join(parts)
        return self._piece(text)

    def _piece(self, text: bytes) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo, self.old = Memo(self._found), self.memo
        if b"<|" in text:  # lower-casing first could make a special string
            return b"".join(map(self.memo.__getitem__, text.split()))
        return b"".join(map(self.memo.__getitem__, text.lower().split()))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and first characters of the tokens, from the library in one call."""
        got = self.tok.encode(text, add_special_tokens=False)
        return np.array(got.ids, np.int64), np.array([a for a, _ in got.offsets], np.int64)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def spliced(encode, text: str, chunk: int, overlap: int) -> Iterator[np.ndarray]:
    """Ids of text from overlapping chunks of so many characters.

    Two neighbours are joined where both start a token after the same white space (nothing before it can change
    what follows) and agree on every token from there to the overlap's last quarter. Where no such place exists the
    overlap is doubled, up to the whole remaining text.
    """
    at, cut, wide = 0, 0, overlap
    ids, starts = encode(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        nxt = max(at, end - wide)
        until = min(len(text), nxt + max(chunk, 2 * wide))
        more_ids, more = encode(text[nxt:until])
        more = more + nxt
        left, right = {int(s): i for i, s in enumerate(starts)}, {int(s): i for i, s in enumerate(more)}
        last = end - (end - nxt) // 4
        place = None
        for s in sorted(left.keys() & right.keys()):
            if nxt < s < last and s >= cut and text[s - 1] in " \t\n\r":
                i, j = left[s], right[s]
                n = int(np.searchsorted(starts, last)) - i
                if np.array_equal(ids[i : i + n], more_ids[j : j + n]) and np.array_equal(starts[i : i + n], more[j : j + n]):
                    place = s
                    break
        if place is None:
            if nxt > at:
                wide *= 2
                continue
            chunk, wide = 2 * chunk, overlap  # the whole chunk overlaps already: encode a longer one from its start
            end = min(len(text), at + chunk)
            ids, starts = encode(text[at:end])
            starts = starts + at
            continue
        yield ids[(starts >= cut) & (starts < place)]
        at, cut, end, wide, ids, starts = nxt, place, until, overlap, more_ids, more
    yield ids[starts >= cut]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Tokens of every whole text under a tokenizers file: (id, n_bytes, n_tokens, over_limit).

    Texts of more than chunk characters are encoded in overlapping chunks with offsets and spliced; the others at
    once. A null or empty text has 0 bytes and 0 tokens; repeated rows and other columns don't matter: one row out for
    each row in, other columns dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            counts = [sum(map(len, spliced(enc.offsets, t.decode(), chunk, overlap))) if len(t) > chunk else len(enc.ids(t)) // 4 for t in texts]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
