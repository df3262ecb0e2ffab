"""Token counts of byte-level BPE by merging with a heap and a linked list, without emitting identifiers.

A text is split at the vocabulary's special strings (one token each, as the model's library takes them by default) and
then by the pattern of byte-level BPE. A word starts as a linked list of its bytes; a heap holds the adjacent pairs that
have a merge. The pair of the lowest rank (the leftmost of equal ones) is popped again and again, its two symbols become
one, and the pairs with the new neighbours are pushed. An entry whose symbols have changed meanwhile is skipped. A word
has as many tokens as it has bytes, less the merges made: O(n log n) for a word of n bytes, however long it is.

Words already counted are kept in two generations of bounded size; their state changes speed only. Null or empty texts
have 0 bytes and 0 tokens, repeated rows get equal counts, an empty table gives an empty table, extra columns stay
(result columns replace namesakes in any case). Each row is judged for itself: nothing is shuffled, and a lost task is
done again from its input alone.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import CLEAR, extended, lean, put_columns

DEFAULT_NAME = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_WORDS, CACHE_CHARS, PART_ROWS = 200_000, 64, 256
#: The split of byte-level BPE; fixed by the format. %L, %N and %O: letters, numbers, all else but white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?%L+| ?%N+| ?%O+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """What merging needs: a symbol of each byte, (rank, merged symbol) of each pair, and the special strings."""

    byte: tuple[int, ...]
    merges: dict[int, tuple[int, int]]
    special: tuple[str, ...]
    odd_letters: str = ""
    odd_numbers: str = ""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_NAME)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else the next free one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def _odd_points(path: str) -> tuple[str, str]:
    """Code points that are letters or numbers here but not for the model's library (another version of Unicode)."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    odd = []
    for kind, a, b in (("L", "a", "b"), ("N", "1", "2")):
        doubtful = (c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind)
        odd.append("".join(c for c in doubtful if len(split(a + c + b)) > 1))
    return odd[0], odd[1]


def read_vocabulary(path: str) -> Vocabulary:
    """Of a .json file with byte-level BPE; other kinds of vocabularies raise an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: byte-level BPE without a normalizer, prefix space or stripping special strings is expected")
    ids, merges = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
    return Vocabulary(tuple(ids[c] for c in byte_alphabet()), merges, tuple(t["content"] for t in added), *_odd_points(path))


def count_merged(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """Symbols that are left when no adjacent pair has a merge any more."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, pair, m[1]) for i in range(n - 1) if (m := merges.get(pair := symbols[i] << 32 | symbols[i + 1]))]
    heapify(heap)
    left = n
    while heap:
        _, i, pair, merged = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] << 32 | symbols[j] != pair:
            continue
        symbols[i], symbols[j] = merged, -1  # no pair holds a negative symbol
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if m := merges.get(pair := merged << 32 | symbols[k]):
                heappush(heap, (m[0], i, pair, m[1]))
        h = before[i]
        if h >= 0 and (m := merges.get(pair := symbols[h] << 32 | merged)):
            heappush(heap, (m[0], h, pair, m[1]))
    return left


class Counter:
    """A vocabulary with the patterns and caches of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        classes = {"%L": r"\p{L}", "%N": r"\p{N}", "%O": r"[^\s\p{L}\p{N}]"}
        self.split = regex.compile(self._pattern(classes)).findall
        odd = [regex.escape(x) for x in (vocabulary.odd_letters, vocabulary.odd_numbers)]
        self.odd = frozenset(vocabulary.odd_letters + vocabulary.odd_numbers)
        if self.odd:
            classes = {"%O": rf"(?:[^\s\p{{L}}\p{{N}}]|[{''.join(odd)}])"} | {k: rf"(?:(?![{x}])\p{{{k[1]}}})" if x else classes[k] for k, x in zip(("%L", "%N"), odd)}
            self.careful = regex.compile(self._pattern(classes)).findall
        special = sorted(filter(None, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    @staticmethod
    def _pattern(classes: dict[str, str]) -> str:
        out = SPLIT
        for name, text in classes.items():
            out = out.replace(name, text)
        return out

    def word(self, word: str) -> int:
        known = self.older.get(word)
        if known is None:
            byte = self.v.byte
            known = count_merged([byte[b] for b in word.encode()], self.v.merges)
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = known
        return known

    def text(self, text: str) -> int:
        n, parts = 0, [text]
        if self.special and (found := len(self.special.findall(text))):
            n, parts = found, self.special.split(text)
        for part in parts:
            careful = not part.isascii() and not self.odd.isdisjoint(part)
            for w in (self.careful if careful else self.split)(part):
                k = self.words.get(w)
                n += self.word(w) if k is None else k
        return n


_LOADED: dict[str, Counter] = {}
CLEAR.append(_LOADED.clear)


def _loaded(key: str, vocabulary: Vocabulary) -> Counter:
    """The vocabulary of this worker, kept from task to task."""
    if key not in _LOADED:
        _LOADED[key] = Counter(vocabulary)
    return _LOADED[key]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. The vocabulary (1 MB) is read by the driver and sent along."""
    vocabulary = read_vocabulary(path or default_path())
    key = hashlib.sha256(repr((sorted(vocabulary.merges.items()), vocabulary[0], vocabulary[2:])).encode()).hexdigest()

    def run(batches):
        counter = _loaded(key, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                n = [counter.text(t) for t in texts]
                size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield put_columns(part, {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return docs.mapInArrow(lean("op13")(run), extended(docs.schema, fields))
