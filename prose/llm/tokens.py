"""Token counts with the whole-token shortcut.

Offline, every vocabulary string that encodes alone as one token is proven to do so by encoding it.
A text is cut at white space exactly where the byte-level pre-tokenizer cuts it; each different
word (with the space before it, if any) is cut into pre-tokens once, those in the proven set count
1 and only the rest goes through the merges. Counts of a batch are then summed by numpy.

Texts in which cutting at ASCII white space could differ from the library (they hold other white
space, or a special token's string) are counted by the library as a whole.

Cases with a defined result: null or empty text has 0 bytes and 0 tokens; a very long text is counted
whole; a text of exactly the limit is not over it; repeated rows are counted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache
from .wordhash import mix64, range_hash, split_words, text_slices

LIMIT = 1024
#: The pre-tokenizer's pattern, public with this kind of vocabulary (a fixed value).
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space beyond \x20 and \x09-\x0D.
OTHER_SPACE = regex.compile("[\x1c-\x1f\x85\xa0  -     　]")
_COUNTERS: dict[str, Counter] = {}


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings, as text, that the tokenizer encodes alone as one token."""
    names = [tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))]
    names = [n for n in names if n and "�" not in n and (m := PRETOKEN.match(n)) and m.end() == len(n)]
    return frozenset(n for n, e in zip(names, tokenizer.encode_batch(names, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = whole_tokens(self.library) if whole is None else whole
        self.cache = WordCache(self._counts)

    def _counts(self, words: list[str]) -> list[list[int]]:
        """The token count of every word, as a list of one number."""
        counts, of, rest = [0] * len(words), [], []
        for k, word in enumerate(words):
            for part in PRETOKEN.findall(word):
                if part in self.whole:
                    counts[k] += 1
                else:
                    of.append(k)
                    rest.append(part)
        for k, e in zip(of, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            counts[k] += len(e.ids)
        return [[c] for c in counts]

    def _value(self, hashes: np.ndarray, word) -> np.ndarray:
        slots, _ = self.cache.lookup(hashes, word)
        return self.cache.ids[self.cache.starts[slots]].astype(np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text of a slice."""
        raw = data.tobytes()
        words = split_words(data, offsets)
        doc, starts, ends = words.doc_of(), words.starts, words.ends
        texts = len(offsets) - 1
        total = np.zeros(texts, dtype=np.int64)
        if len(starts):
            # White space before each word, from the end of the word or text before it.
            gap = np.maximum(np.concatenate([[0], ends[:-1]]), offsets[doc])
            spaced = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 0x20)
            with np.errstate(over="ignore"):
                keys = mix64(words.hashes + spaced.astype(np.uint64))
            own = self._value(keys, lambda i: raw[starts[i] - spaced[i] : ends[i]].decode())
            # The last character of the gap is a token of its own unless it is a space that joins the word.
            own += (starts > gap) & ~spaced
            long = np.flatnonzero(starts - gap > 1)
            own[long] += self._gaps(data, raw, gap[long], starts[long] - 1)
            np.add.at(total, doc, own)
        last = offsets[:-1].copy()
        has = np.diff(words.first) > 0
        last[has] = ends[words.first[1:][has] - 1]
        tail = np.flatnonzero(last < offsets[1:])
        total[tail] += self._gaps(data, raw, last[tail], offsets[1:][tail])
        return total

    def _gaps(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            keys = mix64(range_hash(data, starts, ends, seed=1) + np.uint64(2))
        return self._value(keys, lambda i: raw[starts[i] : ends[i]].decode())

    def odd(self, text: str) -> bool:
        return OTHER_SPACE.search(text) is not None or any(s in text for s in self.specials)


def _counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; nothing is shuffled.

    The proof runs once, before the job; its result, bounded by the vocabulary, is broadcast.
    """
    whole = docs.sparkSession.sparkContext.broadcast(Counter(tokenizer).whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, whole.value)
        for batch in batches:
            texts = batch.column(1)
            for row, stop, data, offsets in text_slices(texts):
                tokens = counter.count(data, offsets)
                odd = [k for k in range(row, stop) if counter.odd(texts[k].as_py() or "")]
                if odd:
                    encoded = counter.library.encode_batch_fast([texts[k].as_py() for k in odd], add_special_tokens=False)
                    tokens[[k - row for k in odd]] = [len(e.ids) for e in encoded]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:stop], pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
