"""Suffix-array dedup: bytes covered by a string that also starts in a document of a smaller id are removed.

Sampled suffixes.  Of the beginnings of `SEED` bytes inside a string of `WINDOW` bytes
the one with the least hash is its anchor, which depends on the string alone: equal
strings in two documents have equal anchors, so only suffixes at anchors (about 6 of
100 bytes) need be indexed, and no match of `WINDOW` bytes is missed.  The strings
that share an anchor follow each other; what they cover together is a piece, of
`WINDOW` to `WINDOW + SEED_ROOM` bytes.

Index.  Documents are packed into slices.  A slice's distinct anchors, sorted by a
fingerprint of their beginnings and dealt by it, are a batch's sampled suffix array.  In
each part batches come into a family of levels one by one: a batch is merge-scanned
against every level for common beginnings and becomes a level itself; levels of equal
size merge, so a part holds no more levels than the logarithm of its batches, and an
entry is merged as often.  Fingerprints (32 bits beside the part) only ever
select too much.  `add` keeps the levels as a table and takes further batches.

Verification.  Pieces of common anchors, distinct in their slice, are dealt by anchor.
A task puts all strings of its pieces into byte order, a suffix array of depth
`WINDOW`, and equal neighbours have the least id of all documents that hold them.
Anchors whose runs alone would fill a task have their strings dealt by the whole of their
bytes instead, so no frequent beginning gathers in one task.  Back in the slices, strings
with a smaller id than their document's cover it.

Texts are shuffled compressed, twice, by slice; nothing is collected but counts.  A slice's
pieces are numbered by the task that verifies them and laid out some at a time, so memory
follows a slice's bytes and not how much of it other slices hold.

Defined results: null text is empty; ids are integers, a null id counts as larger than
any other and rows of equal ids don't take from each other; ids may repeat, each row
gives a row; texts shorter than `WINDOW` bytes keep all; matches don't cross documents
and are judged on the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut

WINDOW, SEED = 50, 16
SEED_ROOM = WINDOW - SEED
#: Bytes of text to a slice, of slices whose entries leave a task together, of text to a part, and of pieces to a verifying task.
SLICE, FLUSH, PART, PIECES = 8 << 20, 64 << 20, 128 << 20, 8 << 20
WIDE = -(-(WINDOW + SEED_ROOM) // 8) * 8
#: Runs that may share an anchor before its strings are dealt by all of their bytes: what a verifying task takes.
HOT = PIECES // WIDE
#: Pieces of a slice that are laid out at once, and strings of a verifying task.
AT_ONCE, STRINGS = 1 << 15, 1 << 17
BLOCK, LOW = 1 << 16, np.uint64((1 << 18) - 1)
NO_ID = np.iinfo("i8").max
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as numbers."""
    return np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))


def _seeds(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of beginnings, from their two halves."""
    return _mixed(_mixed(first * _A) + second * _B)


class Runs(NamedTuple):
    """Stretches of strings that share an anchor: their first and last start, their anchor's tag (part and fingerprint), their document's place."""

    first: np.ndarray
    last: np.ndarray
    tag: np.ndarray
    doc: np.ndarray


def anchored(text: np.ndarray, ends: np.ndarray, parts: int) -> Runs:
    """The runs of documents that stand one after another in text and end at `ends`."""
    n = len(text) - WINDOW + 1
    if n < 1:
        return Runs(*(np.zeros(0, k) for k in ("i4", "i4", "u8", "i4")))
    over = np.maximum(np.concatenate([[0], ends[:-1]]), ends - WINDOW + 1)  # from here to its end strings would cross the end of a document
    told, anchor, upto = [], -1, -1
    for s in range(0, n, BLOCK):
        m = min(BLOCK, n - s)
        words = _words(text[s : s + m + WINDOW - 1]).copy()
        least = _seeds(words[:-8], words[8:]) & ~LOW | np.arange(m + SEED_ROOM, dtype="u8")
        span = 1
        while span * 2 <= SEED_ROOM + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := SEED_ROOM + 1 - span:
            least = np.minimum(least[:-rest], least[rest:])
        docs = slice(np.searchsorted(ends, s, "right"), np.searchsorted(over, s + m))
        edge = np.zeros(m + 1, "i4")
        np.add.at(edge, np.clip(over[docs] - s, 0, m), 1)
        np.add.at(edge, np.clip(ends[docs] - s, 0, m), -1)
        if not len(whole := np.flatnonzero(np.cumsum(edge[:m]) == 0)):
            continue
        held = (least[whole] & LOW).astype("i8") + s
        new = np.flatnonzero(np.diff(held, prepend=anchor))
        place = held[new] - s
        other = _mixed(_seeds(words[place], words[place + 8]) * _B + _A)
        tag = (other >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | other & np.uint64(0xFFFFFFFF)
        first, before = whole[new] + s, np.where(new > 0, whole[new - 1] + s, upto)
        told.append((first.astype("i4"), before.astype("i4"), tag, np.searchsorted(ends, first, "right").astype("i4")))
        anchor, upto = held[-1], whole[-1] + s
    if not told:
        return anchored(text[:0], ends[:0], parts)
    first, before, tag, doc = (np.concatenate(x) for x in zip(*told, strict=True))
    return Runs(first, np.append(before[1:], np.int32(upto)), tag, doc)


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each class of equal rows, class of each row), the same whenever it is asked."""
    if not len(words):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    h = np.zeros((2, len(words)), "u8")
    for k in range(words.shape[1]):
        h[0] = _mixed((h[0] + words[:, k]) * _A + _B)
        h[1] = _mixed((h[1] ^ words[:, k]) * _C + _A)
    order = np.lexsort((h[1], h[0]))
    new = np.ones(len(words), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)  # hashes only bring equal rows together
    classes = np.empty(len(words), "i8")
    classes[order] = np.cumsum(new) - 1
    return order[new], classes


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
#: Where the words of a string of WINDOW bytes begin.
_AT = [*range(0, WINDOW - 8, 8), WINDOW - 8]


def _roomy(flat: np.ndarray) -> np.ndarray:
    """`_words` with zeros after the end, so that WIDE bytes start at each place."""
    return _words(np.concatenate([flat, np.zeros(WIDE, "u1")]))


def _padded(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of WIDE bytes: what starts at these places, zeros after its length; as numbers with the length."""
    start, length = start.astype("i8"), length.astype("i8")
    out = np.empty((len(start), WIDE // 8 + 1), "u8")
    for k in range(WIDE // 8):
        out[:, k] = words[start + 8 * k] & _KEPT[np.clip(length - 8 * k, 0, 8)]
    out[:, -1] = length
    return out


def _blocks(keys: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of about `most` of these ordered keys, with equal keys in one."""
    a = 0
    while a < len(keys):
        b = min(a + most, len(keys))
        if b < len(keys) and (b := int(np.searchsorted(keys, keys[b]))) <= a:
            b = int(np.searchsorted(keys, keys[a], "right"))
        yield slice(a, b)
        a = b


def _matched(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among those asked for, place among the ordered keys) of all that are equal."""
    low = np.searchsorted(keys, asked)
    n = np.searchsorted(keys, asked, "right") - low
    own = np.repeat(np.arange(len(asked)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n - low, n)


class Wanted(NamedTuple):
    """What must be verified of a slice, in the order of the tasks it is dealt to: starts, lengths, tasks."""

    start: np.ndarray
    length: np.ndarray
    deal: np.ndarray


def wanted_of(text: np.ndarray, ends: np.ndarray, parts: int, deals: int, common: np.ndarray, hot: np.ndarray) -> Wanted:
    """Runs of anchors that other slices hold too or that several documents here hold; all strings of those that are hot."""
    runs = anchored(text, ends, parts)
    order = np.lexsort((runs.doc, runs.tag))
    tag, doc = runs.tag[order], runs.doc[order]
    here = np.unique(tag[1:][(tag[1:] == tag[:-1]) & (doc[1:] != doc[:-1])])
    asked = np.isin(runs.tag, common) | np.isin(runs.tag, here)
    first, last, tag = (x[asked] for x in runs[:3])
    del runs, order, doc
    crowded = np.isin(tag, hot)
    whole = ~crowded
    start, length, deal = [first[whole]], [(last - first + WINDOW)[whole].astype("u1")], [(_mixed(tag[whole] + _B) % np.uint64(deals)).astype("u4")]
    first, last, words = first[crowded], last[crowded], _roomy(text)
    for a in range(0, len(first), AT_ONCE):
        each = last[a : a + AT_ONCE] - first[a : a + AT_ONCE] + 1
        at = np.repeat(first[a : a + AT_ONCE] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        told = np.zeros(len(at), "u8")
        for k in _AT:
            told = _mixed((told ^ words[at + k]) * _A + _C)
        start.append(at.astype("i4"))
        length.append(np.full(len(at), WINDOW, "u1"))
        deal.append((told % np.uint64(deals)).astype("u4"))
    start, length, deal = (np.concatenate(x) for x in (start, length, deal))
    order = np.argsort(deal, kind="stable")
    return Wanted(start[order], length[order], deal[order])


class Pieces(NamedTuple):
    """Distinct pieces of a slice in the order of their tasks, the number of the first of them, and where they stand: starts and classes."""

    number: int
    words: np.ndarray
    deal: np.ndarray
    start: np.ndarray
    kind: np.ndarray


def pieces_of(text: np.ndarray, wanted: Wanted) -> Iterator[Pieces]:
    """The pieces of some tasks after another, numbered the same whenever they are asked for."""
    words, number = _roomy(text), 0
    for block in _blocks(wanted.deal, AT_ONCE):
        start, length, deal = (x[block] for x in wanted)
        leading, kind, held = [], [], 0
        for a in range(0, len(start), AT_ONCE):  # several of them where one task takes very many, mostly equal ones
            first, each = distinct(_padded(words, start[a : a + AT_ONCE], length[a : a + AT_ONCE]))
            leading.append(a + first)
            kind.append(held + each)
            held += len(first)
        leading, kind = np.concatenate(leading), np.concatenate(kind)
        if len(start) > AT_ONCE:
            first, each = distinct(_padded(words, start[leading], length[leading]))
            leading, kind = leading[first], each[kind]
        order = np.argsort(deal[leading], kind="stable")
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        leading = leading[order]
        yield Pieces(number, _padded(words, start[leading], length[leading]), deal[leading], start, rank[kind])
        number += len(leading)


class Stretches(NamedTuple):
    """Strings of distinct pieces that follow each other and have one least id: the piece's class, the first string's place in it, their number."""

    kind: np.ndarray
    into: np.ndarray
    size: np.ndarray
    least: np.ndarray


def least_ids(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Stretches]:
    """(class of each piece, the least ids of the holders of their strings): a suffix array of depth WINDOW over the pieces."""
    leading, kind = distinct(words)
    least = np.full(len(leading), NO_ID)
    np.minimum.at(least, kind, ids)
    each = words[leading, -1].astype("i8") - WINDOW + 1
    flat = np.ascontiguousarray(words[leading, :-1]).view("u1").ravel()
    begin = np.cumsum(each) - each
    own = np.repeat(np.arange(len(leading), dtype="i4"), each)
    at = np.repeat(np.arange(len(leading)) * WIDE - begin, each) + np.arange(len(own))
    found = np.empty(len(own), "i8")
    head = _words(flat)[at].byteswap() if len(at) else np.zeros(0, "u8")  # in the order of their bytes
    order = np.argsort(head, kind="stable")
    head = head[order]
    for block in _blocks(head, STRINGS):
        some = order[block]
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[at[some]]).view(f"S{WINDOW}").ravel()
        rank = np.argsort(strings, kind="stable")
        strings, some = strings[rank], some[rank]
        new = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
        found[some] = np.repeat(np.minimum.reduceat(least[own[some]], new), np.diff(np.append(new, len(some))))
    new = np.ones(len(own), bool)
    new[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    new = np.flatnonzero(new)
    return kind, Stretches(own[new], (new - begin[own[new]]).astype("u1"), np.diff(np.append(new, len(own))).astype("u1"), found[new])


class Level(NamedTuple):
    """Distinct fingerprints in order, the slice that brought each first, how many runs it has, whether a batch of this call has it too, and how many batches the level is made of."""

    keys: np.ndarray
    owner: np.ndarray
    runs: np.ndarray
    touched: np.ndarray
    batches: int


class Family:
    """The levels of one part.  `others` are the slices that hold a key beside its owner, as (key, slice), from earlier calls."""

    def __init__(self, levels: list[Level] = (), others: list[tuple[np.ndarray, np.ndarray]] = ()):
        self.levels, self.others = list(levels), list(others)
        self.owners: list[tuple[np.ndarray, np.ndarray]] = []
        self.later: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, slice_id: int, keys: np.ndarray, runs: np.ndarray | None = None) -> None:
        """Merge-scan a batch's sorted distinct keys (with the runs of each, else one) against all levels, note what is common, and let equal levels merge."""
        runs = np.ones(len(keys), "i8") if runs is None else runs
        seen = np.zeros(len(keys), bool)
        for level in self.levels:
            if not len(level.keys):
                continue
            place = np.searchsorted(level.keys, keys)
            place[place == len(level.keys)] = 0
            met = level.keys[place] == keys
            at = place[met]
            once = at[~level.touched[at]]
            self.owners.append((level.keys[once], level.owner[once]))
            level.runs[at] += runs[met]
            level.touched[at] = True
            seen |= met
        self.later.append((keys[seen], np.full(seen.sum(), slice_id)))
        fresh = keys[~seen]
        self._push(Level(fresh, np.full(len(fresh), slice_id), runs[~seen].astype("i8"), np.zeros(len(fresh), bool), 1))

    def _push(self, level: Level) -> None:
        while self.levels and self.levels[-1].batches <= level.batches:
            other = self.levels.pop()
            # their keys differ: what a level holds already doesn't enter a later one
            place = np.searchsorted(other.keys, level.keys)
            level = Level(*(np.insert(a, place, b) for a, b in zip(other[:4], level[:4], strict=True)), other.batches + level.batches)
        self.levels.append(level)

    def found(self, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice, key, whether it has more than `hot` runs) of all that batches of this call have in common with any slice."""
        none = np.zeros(0, "u4"), np.zeros(0, "i8")
        touched, crowded = (np.concatenate([none[0], *x]) for x in ([v.keys[v.touched] for v in self.levels], [v.keys[v.runs > hot] for v in self.levels]))
        before = [(k[m], s[m]) for k, s in self.others for m in [np.isin(k, touched)]]
        keys, owner = (np.concatenate(x) for x in zip(none, *self.owners, *self.later, *before, strict=True))
        return owner, keys, np.isin(keys, crowded)


def _pack(number: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, count = [], [], 0, 0
        squeeze = zstandard.ZstdCompressor(level=6)

        def row() -> pa.RecordBatch:
            at = number << 48 | TaskContext.get().partitionId() << 20 | count
            ends = np.cumsum([len(t) for t in texts]).astype("i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.binary()), pa.array([squeeze.compress(b"".join(texts))], pa.binary()), pa.array([held], pa.int64())], ["slice", "ids", "ends", "body", "bytes"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if texts and held + len(t) > most:
                    yield row()
                    ids, texts, held, count = [], [], 0, count + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield row()

    return run


def _text(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, size)), "u1")


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """What `_blob` put together."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "i8", len(kinds))
    edges = 8 * len(kinds) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(data[a:b], k) for a, b, k in zip(edges[:-1], edges[1:], kinds, strict=True)]


def _blob(*arrays: np.ndarray) -> bytes:
    told = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(t) for t in told], "i8").tobytes() + b"".join(told))


def _steps(ordered: np.ndarray) -> np.ndarray:
    """From zero to the first of these and from each to the next, for `_blob`."""
    return np.diff(ordered, prepend=np.uint32(0))


def _entries(parts: int):
    """For each part the sorted anchors of a few slices with their numbers of runs: one row a part for every FLUSH bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            blobs = [_blob(np.array([s for s, _, _ in x], "i8"), np.array([len(k) for _, k, _ in x], "i8"), np.concatenate([_steps(k) for _, k, _ in x]), np.concatenate([n for _, _, n in x])) for x in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], ["part", "keys"])

        for batch in batches:
            for at, ends, body, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                tags, runs = np.unique(anchored(_text(body, n), np.frombuffer(ends, "i8"), parts).tag, return_counts=True)
                edges = np.flatnonzero(np.diff(tags >> np.uint64(32), prepend=np.uint64(2**32), append=np.uint64(2**32)))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    held.setdefault(int(tags[a] >> np.uint64(32)), []).append((at, tags[a:b].astype("u4"), runs[a:b].astype("u4")))
                size += n
                if size > FLUSH:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    return run


def _scan(parts: int, hot: int, keep: bool):
    """Rows of a part: new entries (batches null), levels (their batches) and other holders (no batches)."""

    def run(rows: pa.Table) -> pa.Table:
        part, told = rows.column("part")[0].as_py(), list(zip(rows.column("keys").to_pylist(), rows.column("batches").to_pylist(), strict=True))
        levels = [Level(k, o, s.copy(), np.zeros(len(k), bool), n) for b, n in sorted((x for x in told if x[1]), key=lambda x: -x[1]) for k, o, s in [_arrays(b, "u4", "i8", "i8")]]
        family = Family(levels, [tuple(_arrays(b, "u4", "i8")) for b, n in told if n == 0])
        new = []
        for at, sizes, steps, runs in (_arrays(b, "i8", "i8", "u4", "u4") for b, n in told if n is None):
            edges = np.concatenate([[0], np.cumsum(sizes)])
            new += [(int(s), np.cumsum(steps[a:b], dtype="u8").astype("u4"), runs[a:b]) for s, a, b in zip(at, edges[:-1], edges[1:], strict=True)]
        for at, keys, runs in sorted(new, key=lambda x: x[0]):
            family.add(at, keys, runs)
        owner, keys, crowded = family.found(hot)
        order = np.lexsort((keys, owner))
        owner, keys, crowded = owner[order], keys[order], crowded[order]
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(0, "i8")
        out = [(int(owner[a]), part, _blob(_steps(keys[a:b]), crowded[a:b]), b - a, None) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if keep:
            out += [(None, part, _blob(*v[:3]), len(v.keys), v.batches) for v in family.levels]
            beside = [np.concatenate(x) for x in zip(*family.others, *family.later, strict=True)] if family.later or family.others else []
            out += [(None, part, _blob(*beside), len(beside[0]), 0)] if beside else []
        kinds = ("slice", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.int64()), ("batches", pa.int32())
        return pa.table([pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(kinds)], names=[c for c, _ in kinds])

    return run


def _noted(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tags that other slices hold, those of them that have very many runs) from a slice's rows."""
    common, hot = [np.zeros(0, "u8")], [np.zeros(0, "u8")]
    for part, blob, kind in zip(notes.column("part").to_pylist(), notes.column("keys").to_pylist(), notes.column("kind").to_pylist(), strict=True):
        if kind == 0:
            steps, crowded = _arrays(blob, "u4", "?")
            tags = np.uint64(part) << np.uint64(32) | np.cumsum(steps, dtype="u8")
            common.append(tags)
            hot.append(tags[crowded])
    return np.concatenate(common), np.concatenate(hot)


def _opened(rows: pa.Table, notes: pa.Table, parts: int, deals: int):
    """(id array with NO_ID for null, text, ends, what must be verified) of a slice."""
    ids = np.array([NO_ID if i is None else i for i in rows.column("ids")[0].as_py()], "i8")
    ends = np.frombuffer(rows.column("ends")[0].as_py(), "i8")
    text = _text(rows.column("body")[0].as_py(), rows.column("bytes")[0].as_py())
    return ids, text, ends, wanted_of(text, ends, parts, deals, *_noted(notes))


def _told(parts: int, deals: int, number: int):
    """A slice's distinct pieces by the task that verifies them.  Slices of earlier batches take part where they have something in common with new ones."""

    def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
        out = {"deal": [], "slice": [], "pieces": []}
        if rows.num_rows and (notes.num_rows or rows.column("slice")[0].as_py() >> 48 >= number):
            ids, text, ends, wanted = _opened(rows, notes, parts, deals)
            for p in pieces_of(text, wanted):
                own = ids[np.searchsorted(ends, p.start, "right")]
                low, high = np.full(len(p.words), NO_ID), np.full(len(p.words), np.iinfo("i8").min)
                np.minimum.at(low, p.kind, own)
                np.maximum.at(high, p.kind, own)
                flat, lengths, above = np.ascontiguousarray(p.words[:, :-1]).view("u1"), p.words[:, -1].astype("u1"), high.view("u8") - low.view("u8")
                edges = np.flatnonzero(np.diff(p.deal.astype("i8"), prepend=-1, append=-1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    body = flat[a:b][np.arange(WIDE) < lengths[a:b, None]]
                    out["deal"].append(int(p.deal[a]))
                    out["pieces"].append(_blob(np.array([p.number + a], "u4"), lengths[a:b], low[a:b], above[a:b], body))
            out["slice"] = [rows.column("slice")[0].as_py()] * len(out["deal"])
        return pa.table([pa.array(out["deal"], pa.int64()), pa.array(out["slice"], pa.int64()), pa.array(out["pieces"], pa.binary())], names=list(out))

    return run


def _verified(rows: pa.Table) -> pa.Table:
    """The least ids of all strings of the pieces dealt to a task, for the slices whose documents they cover."""
    told = [_arrays(b, "u4", "u1", "i8", "u8", "u1") for b in rows.column("pieces").to_pylist()]
    number, lengths, low, above, body = (np.concatenate(x) for x in zip(*told, strict=True))
    many = np.array([len(t[1]) for t in told])
    del told
    of = np.repeat(np.arange(len(many)), many)
    number = np.repeat(number.astype("i8") - (np.cumsum(many) - many), many) + np.arange(len(of))
    kind, stretches = least_ids(_padded(_roomy(body), np.cumsum(lengths, dtype="i8") - lengths, lengths), low)
    piece, at = _matched(stretches.kind, kind)
    covers = stretches.least[at] < (low.view("u8") + above).view("i8")[piece]
    piece, at = piece[covers], at[covers]
    edges = np.searchsorted(of[piece], np.arange(len(many) + 1)).tolist()
    out = {"slice": [], "keys": []}
    for s, a, b in zip(rows.column("slice").to_pylist(), edges[:-1], edges[1:], strict=True):
        if a < b:
            some = at[a:b]
            out["slice"].append(s)
            out["keys"].append(_blob(_steps(number[piece[a:b]].astype("u4")), stretches.into[some], stretches.size[some], stretches.least[some]))
    return pa.table([pa.array(out["slice"], pa.int64()), pa.array(out["keys"], pa.binary())], names=list(out))


def _removed(parts: int, deals: int, texts: bool):
    def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        ids, text, ends, wanted = _opened(rows, notes, parts, deals)
        change = np.zeros(len(text) + 1, "i4")
        hits = [_arrays(b, "u4", "u1", "u1", "i8") for b, kind in zip(notes.column("keys").to_pylist(), notes.column("kind").to_pylist(), strict=True) if kind == 1]
        if hits:
            number, into, size, least = (np.concatenate(x) for x in zip(*((np.cumsum(h[0], dtype="i8"), *h[1:]) for h in hits), strict=True))
            order = np.argsort(number, kind="stable")
            number, into, size, least = number[order], into[order], size[order], least[order]
            for p in pieces_of(text, wanted):
                some = slice(*np.searchsorted(number, [p.number, p.number + len(p.words)]))
                own, at = _matched(number[some] - p.number, p.kind)
                at += some.start
                covered = least[at] < ids[np.searchsorted(ends, p.start, "right")][own]
                own, at = own[covered], at[covered]
                start = p.start[own].astype("i8") + into[at]
                np.add.at(change, start, 1)
                np.add.at(change, start + size[at] + (WINDOW - 1), -1)
        gone = np.cumsum(change, dtype="i4", out=change)[:-1] > 0
        out = []
        for i, a, b in zip(rows.column("ids")[0].as_py(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            own = gone[a:b]
            kept = (text[a:b] if not own.any() else text[a:b][~own]).tobytes()
            out.append((i, b - a, int(own.sum()), int((np.diff(own.astype("i1"), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


class Index(NamedTuple):
    """What later batches are held against: packed texts, levels by part, the number of parts and of batches so far."""

    slices: DataFrame
    levels: DataFrame
    parts: int
    batches: int


def add(documents: DataFrame, index: Index | None = None, keep: bool = True, hot: int = HOT, texts: bool = False, slice_bytes: int = SLICE, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Index | None]:
    """(what is removed from these documents, the index with them in it).

    Rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.  Documents of the index that have smaller ids take from
    these; documents that it holds already are not judged again, so batches should come in order of their ids.
    """
    spark = documents.sparkSession
    held = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    number = index.batches if index else 0
    fresh = cut(held.mapInArrow(_pack(number, slice_bytes), "slice long, ids array<long>, ends binary, body binary, bytes long"))
    total, count = fresh.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = index.parts if index else max(width, math.ceil(total / PART))
    entries = fresh.mapInArrow(_entries(parts), "part int, keys binary").withColumn("batches", F.lit(None).cast("int"))
    if index:
        entries = entries.unionByName(index.levels.select("part", "keys", "batches"))
    scanned = cut(entries.groupBy("part").applyInArrow(_scan(parts, hot, keep), "slice long, part int, keys binary, n long, batches int"))
    flags = scanned.where("batches is null").select("slice", "part", "keys", F.lit(0).alias("kind"))
    shared = scanned.where("batches is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_slices = index.slices.unionByName(fresh) if index else fresh
    deals = max(width, math.ceil(shared * WIDE / PIECES))
    told = all_slices.groupBy("slice").cogroup(flags.groupBy("slice")).applyInArrow(_told(parts, deals, number), "deal long, slice long, pieces binary")
    hits = told.groupBy("deal").applyInArrow(_verified, "slice long, keys binary")
    notes = flags.unionByName(hits.select("slice", F.lit(None).cast("int").alias("part"), "keys", F.lit(1).alias("kind")))
    rows = fresh.groupBy("slice").cogroup(notes.groupBy("slice")).applyInArrow(_removed(parts, deals, texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = rows.select(F.col("id").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))
    levels = scanned.where("batches is not null").select("part", "keys", "batches")
    return out, Index(all_slices, levels, parts, number + 1) if keep else None


def remove_repeats(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents of a table, held against each other."""
    return add(documents, keep=False, **options)[0]
