"""Token counts without token ids.

Pre-tokens are the tokenizer's own: what its normaliser and its split make of a text.

1. Tasks count pre-tokens; one grouped sum gives each distinct one's frequency.
2. The library counts the pieces of each distinct pre-token, once.
3. The most frequent ones, ``HOT`` bytes at most whatever the corpus holds, are sent to
   every task; documents add those up where they lie.
4. All other pre-tokens of a document are joined to the counted table by a shuffle
   on the pre-token, summed by document.

Nothing is left out: a pre-token is either in the bounded hot table or joined.

Texts are split by the tokenizer's own pattern at once where all their characters are
plain: composed, of the basic plane, and the same kind and lower case in the Unicode
data of 3.2 as today, so that library and Python agree on them.  Other texts are split
word by word by the library; a word with one of its added tokens is kept whole.

Defined results: null text reads as empty and counts zero tokens; repeated rows and
ids each give a row; null ids are kept; an empty table gives no rows; other columns
of the input are ignored; a tokenizer that keeps white space is refused.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import Bounded, cut, slices, text_of

#: Bytes of pre-tokens, each with its own weight in a table, that a task counts before it hands them on.
HELD = 24 << 20
#: Bytes of the most frequent pre-tokens sent to all tasks: a bound that doesn't grow with the corpus.
HOT = 10 << 20
#: What an entry of a table takes besides its characters.
ENTRY = 64
# Unicode white space, which Python's split() widens by U+001C to U+001F.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_BLANK}]+")
_WIDER = re.compile("[\x1c-\x1f]")
#: Marks a word kept whole; no pre-token holds a space.
_WHOLE = " "
_PROBES = ["a b", "it's  12\tO'Neil's", "x\u3000y z \xe9\xc9 __ -- 3.4,5", "don't!! \u0395\u03a3 \xe9 \u4e2d\u6587 \ufb01", " lead and trail\n", "I'M'VE 'tis'd \u2019s \u2014 \xbd\xb2 \u0130", "-'s'll--'re 1a2b_c", "\U0001f600x"]
_held: dict = {}


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _WIDER.search(text) else text.split()


def _ranges(test: Callable[[int], bool]) -> str:
    """A character class of the code points of the basic plane that pass."""
    runs = [[c for c, _ in run] for ok, run in groupby(((c, test(c)) for c in range(0x10000)), lambda x: x[1]) if ok]
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


def _odd(c: int) -> bool:
    """Whether libraries may differ on a character."""
    then, char = unicodedata.ucd_3_2_0, chr(c)
    return then.category(char)[0] != unicodedata.category(char)[0] or then.category(char) in ("Cn", "Cs") or c in (0x130, 0x3A3)


class PreTokens:
    """The pre-tokens of texts, and the number of tokens of a pre-token, by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.of = Bounded(self._of)
        self.find = self._pattern(path)
        self.odd = re.compile(f"[{_ranges(_odd)}\U00010000-\U0010ffff]")
        if any(_SPACE.search(t) for t in added) or any(self._whole(t) != sum(map(self.count, self.split(t))) for t in _PROBES):
            raise ValueError(f"{path}: not a tokenizer whose pre-tokens end at white space and drop it")
        if self.find and any(self.find(t.lower()) != [p for w in words_of(t) for p in self._of(w)] for t in _PROBES if self._plain(t)):
            self.find = None

    def _pattern(self, path: str):
        """The split's pattern with its classes spelt out, if lower case and this split are all that the tokenizer does."""
        with open(path, encoding="utf-8") as text:
            whole = json.load(text)
        splits = [p["pattern"]["Regex"] for p in (whole.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split" and "Regex" in p["pattern"]]
        if len(splits) != 1 or not any(n.get("type") == "Lowercase" for n in (whole.get("normalizer") or {}).get("normalizers", [])):
            return None
        kinds = {r"\p{L}": _ranges(lambda c: unicodedata.category(chr(c))[0] == "L"), r"\p{N}": _ranges(lambda c: unicodedata.category(chr(c))[0] == "N"), r"\s": _BLANK}
        spelt = splits[0]
        for name, ranges in kinds.items():
            spelt = spelt.replace(name, ranges)
        return None if "\\p" in spelt else re.compile(spelt).findall

    def _plain(self, text: str) -> bool:
        return not self.odd.search(text) and not (self.added and self.added.search(text)) and unicodedata.is_normalized("NFC", text)

    def split(self, text: str) -> list[str]:
        if self.find and self._plain(text):
            return self.find(text.lower())
        return [p for w in words_of(text) for p in self.of[w]]

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _of(self, word: str) -> tuple[str, ...]:
        if self.added and self.added.search(word):
            return (_WHOLE + word,)
        shape, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        shaped = shape.normalize_str(word) if shape else word
        return tuple(shaped[a:b] for _, (a, b) in split.pre_tokenize_str(shaped)) if split else (shaped,)

    def count(self, piece: str) -> int:
        return self._whole(piece[1:] if piece[0] == _WHOLE else piece)


def pre_tokens(path: str) -> PreTokens:
    """One a worker process."""
    if path not in _held:
        _held.clear()
        _held[path] = PreTokens(path)
    return _held[path]


def _tally(path: str):
    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, weight = pre_tokens(path).split, Counter(), 0
        for batch in slices(batches):
            fresh: Counter = Counter()
            for text in batch.column(0).to_pylist():
                fresh.update(split(text))
            weight += sum(map(len, fresh)) + 2 * ENTRY * len(fresh)
            held.update(fresh)
            if weight > HELD:  # what came again counts once
                weight = sum(map(len, held)) + 2 * ENTRY * len(held)
            if weight > HELD:
                yield out(held)
                held, weight = Counter(), 0
        yield out(held)

    return run


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre_tokens(path).count
        for batch in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(count, batch.column(0).to_pylist()), pa.int64())], ["piece", "freq", "n"])

    return run


def counted_pieces(documents: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """piece, freq, n: each distinct pre-token, how often it occurs, and its number of tokens."""
    words = documents.select(text_of(text).alias("t")).mapInArrow(_tally(tokenizer_path), "piece string, freq long")
    distinct = words.groupBy("piece").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(_counter(tokenizer_path), "piece string, freq long, n long")


def _hot_floor(counted: DataFrame, most: int) -> int:
    """The least frequency at which the pre-tokens take no more than `most` bytes, from a histogram in eighths of powers of two."""
    step = F.floor(F.log2("freq") * 8).alias("step")
    rows = counted.groupBy(step).agg(F.sum(F.octet_length("piece") + ENTRY).alias("size"), F.min("freq").alias("least")).collect()
    total, floor = 0, None
    for row in sorted(rows, key=lambda r: -r["step"]):
        total += row["size"]
        if total > most:
            break
        floor = row["least"]
    return floor if floor is not None else 2**62


def count_tokens(documents: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    pre_tokens(tokenizer_path)  # refuses unfit tokenizers before any work is done
    spark = documents.sparkSession
    counted = cut(counted_pieces(documents, tokenizer_path, text))
    is_hot = F.col("freq") >= _hot_floor(counted, hot)
    shared = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in counted.where(is_hot).select("piece", "n").toLocalIterator()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, under a key of its own, with its hot tokens, and one for each other pre-token of it."""
        split_text, known = pre_tokens(tokenizer_path).split, shared.value.get
        for batch in slices(batches):
            numbers, owner, place, pieces, times = batch.column(0).to_pylist(), [], [], [], []
            for at, body in enumerate(batch.column(2).to_pylist()):
                found = split_text(body)
                counts = list(map(known, found))
                rest: Counter = Counter()
                if None in counts:
                    rest.update(p for p, n in zip(found, counts, strict=True) if n is None)
                base = sum(n for n in counts if n is not None) if rest else sum(counts)
                owner += [numbers[at]] * (1 + len(rest))
                place += [at] + [None] * len(rest)
                pieces += [f"\n{numbers[at]}", *rest]
                times += [base, *rest.values()]
            head = pa.array(place, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), batch.column(1).take(head), batch.column(3).take(head), pa.array(pieces, pa.string()), pa.array(times, pa.int64())], ["row", "id", "n_bytes", "piece", "times"])

    kind = documents.schema[doc_id].dataType.simpleString()
    body = text_of(text)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), body.alias("t"), F.octet_length(body).cast("long").alias("n_bytes")).mapInArrow(split, f"row long, id {kind}, n_bytes long, piece string, times long")
    joined = rows.join(counted.where(~is_hot).select("piece", "n"), "piece", "left")
    # a document's own row joins nothing and counts as it stands
    summed = joined.groupBy("row").agg(F.max_by("id", F.col("n_bytes").isNotNull()).alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("times") * F.coalesce("n", F.lit(1))).alias("n_tokens"))
    return summed.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
