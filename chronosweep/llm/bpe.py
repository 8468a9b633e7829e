"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string, byte-pair merging has one last token.  A token
is that last token exactly if it ends the prefix and *fits behind* the last token
of the prefix that it leaves: merging the two tokens' joined bytes gives the two
back.  So one forward pass stores each prefix's last token; the encoding is read
from the end, an append goes on from where the table stops, and an edit recomputes
the table only until it agrees with the old one for as long as the longest token.

Texts are split by a pattern first and each match is encoded on its own.  Inside a
task, encodings of distinct stretches of text are kept in a bounded table, so
frequent words run through the pass once.

Defined results: null text reads as empty and has no ids; repeated rows and ids
each give a row; null ids are kept; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import Bounded, _weight, kept, slices, text_of

_NONE = 1 << 62
#: Bytes of the pieces whose prefixes share one table.
SHORT = 64
#: Bytes that a task keeps of each kind, and of words.
KEPT, WORDS_KEPT = 64 << 20, 192 << 20
_NOTHING = object()


class Kept(Bounded):
    """A bounded table that keeps what was used of late: once half of its bytes are full, these are the older half and a new one starts."""

    def __init__(self, make: Callable, most: int):
        super().__init__(make, most // 2)
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key, _NOTHING)
        if value is _NOTHING:
            value = self.make(key)
        weight = 200 + sum(_weight(x) for x in (key, value))
        if weight * 1000 <= self.most:
            self.held += weight
            if self.held > self.most:
                self.older, self.held = dict(self), weight
                self.clear()
            self[key] = value
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Ranks, and each prefix's last token, by the prefix itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.id_bytes = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        self.longest = max(map(len, ranks), default=1)
        # the longest token that ends in three bytes: what a prefix that ends so must be probed for
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 2))
        self.halves = Kept(self._halves, KEPT)
        self.fits = Kept(self._fits, KEPT)
        self.last = Kept(self._last, KEPT)
        self.encoded = Kept(self._encoded, KEPT)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if merging never makes it."""
        data, get = self.bytes_of[token], self.ranks.get
        parts, made = [data[i : i + 1] for i in range(len(data))], (token, token)
        while len(parts) > 1:
            least, i = min((get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if least == _NONE:
                return None
            made = (get(parts[i]), get(parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return made

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the two tokens side by side: going back in time, no earlier merge joins what faces across their border."""
        left, right = pair
        if not (self.halves[left] and self.halves[right]):
            return False
        get, bytes_of, halves = self.ranks.get, self.bytes_of, self.halves
        ended, left_first = _NONE, False
        while True:
            joined = get(bytes_of[left] + bytes_of[right], _NONE)
            # equal ranks merge from the left, so the border's merge comes before one on its right
            if joined < ended or joined == ended != _NONE and left_first:
                return False
            single = len(bytes_of[left]) == 1, len(bytes_of[right]) == 1
            if all(single):
                return True
            if single[1] or not single[0] and left > right:
                ended, left, left_first = left, halves[left][1], False
            else:
                ended, right, left_first = right, halves[right][0], True

    def last_of(self, data: bytes, end: int, last: Callable[[int], int]) -> int:
        """The last token of data[:end], given those of its shorter prefixes."""
        get, fits = self.ranks.get, self.fits
        for length in range(min(end, self.reach.get(data[end - 3 : end], 2)) if end > 2 else end, 0, -1):
            token = get(data[end - length : end])
            if token is not None:
                if length == end:
                    if self.halves[token]:
                        return token
                elif fits[last(end - length), token]:
                    return token
        raise ValueError("the ranks lack a single byte")

    def _last(self, prefix: bytes) -> int:
        table = self.last
        return self.last_of(prefix, len(prefix), lambda end: table[prefix[:end]])

    def _encoded(self, piece: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  Short pieces share their prefixes in one table."""
        if len(piece) > SHORT:
            return b"".join([self.id_bytes[t] for t in Prefixes(self, piece).tokens()])
        out = []
        while piece:
            token = self.last[piece]
            out.append(self.id_bytes[token])
            piece = piece[: -len(self.bytes_of[token])]
        return b"".join(reversed(out))


class Prefixes:
    """One byte string and, for each of its prefixes, the last token of that prefix's encoding."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def _extend(self, end: int) -> None:
        self.last.append(self.encoder.last_of(self.data, end, lambda at: self.last[at - 1]))

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes had to be worked out anew."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start]
        agree = done = 0
        for end in range(start + 1, len(self.data) + 1):
            # from here on, every token looks back only at prefixes that agree
            if agree >= self.encoder.longest:
                self.last.extend(old[end - 1 - shift :])
                break
            self._extend(end)
            done += 1
            same = end > start + len(data) and old[end - 1 - shift] == self.last[-1]
            agree = agree + 1 if same else 0
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.encoder.bytes_of[out[-1]])
        return out[::-1]


class TextEncoder:
    """Whole texts: split by the pattern, encode each match, decode ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = PrefixEncoder(ranks)
        self.find = regex.compile(pattern).findall
        self.token_bytes = [self.pieces.bytes_of.get(i, b"") for i in range(max(self.pieces.bytes_of, default=-1) + 1)]
        self.stretches = Kept(self._stretch, KEPT)
        self.spaced = Kept(lambda word: self._stretch(" " + word), WORDS_KEPT)

    def _stretch(self, text: str) -> bytes:
        encoded = self.pieces.encoded
        return b"".join([encoded[piece.encode()] for piece in self.find(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.split(" ")
        # A space between two characters that aren't white space always starts a match,
        # so the stretches between such spaces can be encoded, and kept, one by one.
        flat = text.replace("\n", "_") if "\n" in text and "\n " not in text and " \n" not in text else text
        if flat.split() == (words if flat is text else flat.split(" ")):
            return b"".join([self.stretches[words[0]], *map(self.spaced.__getitem__, words[1:])])
        found, at = [], 0
        for space in _INNER_SPACE.finditer(text):
            found.append(self.stretches[text[at : space.start()]])
            at = space.start()
        return b"".join(found) + self.stretches[text[at:]]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_INNER_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def _encoder(path: str, pattern: str) -> TextEncoder:
    return kept((path, pattern), lambda: TextEncoder(read_ranks(path), pattern))


def _encode(documents: DataFrame, path: str, pattern: str, doc_id: str, text: str, outputs: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in slices(batches):
            arrays, names = outputs(encoder, [encoder.encode(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [doc_id, *names])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id), text_of(text).alias("t")).mapInArrow(run, f"`{doc_id}` {kind}, {schema}")


def encode_bpe(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def outputs(encoder: TextEncoder, coded: list[bytes]):
        return [_id_lists(coded)], ["ids"]

    return _encode(documents, path, pattern, doc_id, text, outputs, "ids array<int>")


def decode_bpe(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, data binary: the bytes that the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, "")
        for batch in slices(batches):
            data = [None if x is None else encoder.decode(np.array(x, "u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [doc_id, "data"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id), F.col(ids)).mapInArrow(run, f"`{doc_id}` {kind}, data binary")


def _id_lists(coded: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<u4").astype("int32")))


def digest_bpe(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them; the ids too if wanted."""

    def outputs(encoder: TextEncoder, coded: list[bytes]):
        decoded = [encoder.decode(np.frombuffer(c, "<u4")) for c in coded]
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        arrays = [pa.array([len(c) // 4 for c in coded], pa.int64()), sha(coded), sha(decoded)]
        return arrays + [_id_lists(coded)] * with_ids, ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    return _encode(documents, path, pattern, doc_id, text, outputs, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
