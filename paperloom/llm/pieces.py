"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are not known yet are concatenated and indexed by a suffix array (sorted to the length of
the longest piece by doubling); binary search finds the range of suffixes that begin with each piece, which gives every
occurrence of every piece as an edge from its start to its end. Edges are sorted by end and relaxed from left to
right: a prefix of a word is reached by the one edge whose piece may stand after the last piece of the prefix it
starts from. For BPE vocabularies a segmentation is the one that merging makes exactly if that holds for each pair of
neighbours, so relaxation gives the same ids as merging does; whether two pieces may be neighbours is found by merging
the two alone, once per pair. Characters without a piece become byte pieces, which nothing merges with.

Text is normalised as the model's identity rule has it: a dummy prefix, spaces as U+2581, nothing removed. Words are
a run of U+2581 with what follows up to the next one or a newline; no piece reaches over such a border (checked).
Null or empty texts have no ids. A text that holds U+2581 itself decodes to spaces there, as with the model's own
library. Words already encoded are kept in two generations of bounded size (a word met again moves to the younger one,
which replaces the older when it is full); their state changes speed only. Repeated rows get equal ids, an empty table
gives an empty table, extra columns stay (result columns replace namesakes).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import CLEAR, U64, extended, lean, put_columns, ranges

MARK = "▁"
WORD = re.compile(f"\n|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")
DEEP = 16
NEW_CHARS, CACHE_WORDS, PAIR_BITS = 1 << 17, 180_000, 21
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Pieces:
    """A vocabulary with its search keys, and the caches of one worker."""

    def __init__(self, model: list[tuple[str, float, str]]):
        self.ids = {p: i for i, (p, _, k) in enumerate(model) if k == "normal"}
        self.score = {p: s for p, s, k in model if k == "normal"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == "byte"}
        raw = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of = [raw.get(i, b"") for i in range(len(model))]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        assert max(map(len, self.ids)) <= DEEP and not any(MARK in p.lstrip(MARK) for p in self.ids)
        alphabet = sorted({c for p in self.ids for c in p})
        assert len(alphabet) < 65_000
        self.rank = np.full(0x110000, len(alphabet) + 1, np.uint16)
        for k, c in enumerate(alphabet):
            self.rank[ord(c)] = k + 1
        names = sorted(self.ids)  # ascending needles make binary search several times faster
        self.piece_id = np.array([self.ids[p] for p in names], np.int64)
        self.piece_len = np.array([len(p) for p in names], np.int64)
        chars = np.zeros((len(names), DEEP), np.uint16)
        for k, p in enumerate(names):
            chars[k, : len(p)] = self.rank[[ord(c) for c in p]]
        top = np.where(np.arange(DEEP) < self.piece_len[:, None], chars, 0xFFFF)
        self.low, self.high = self._quads(chars), self._quads(top)
        self.length = np.zeros(len(model) + 1, np.int64)
        self.length[self.piece_id] = self.piece_len
        self.length[-1] = 1  # id -1: a character without a piece
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _quads(chars: np.ndarray) -> np.ndarray:
        c = chars.astype(U64).reshape(len(chars), -1, 4)
        return (c[:, :, 0] << U64(48)) | (c[:, :, 1] << U64(32)) | (c[:, :, 2] << U64(16)) | c[:, :, 3]

    # ------------------------------------------------------------ merging two pieces
    def merged(self, text: str) -> list[str]:
        """Plain BPE: the best-scored pair, leftmost first, is merged while there is one."""
        parts, get, none = list(text), self.score.get, -np.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def neighbours(self, left: np.ndarray, right: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether right may stand after left (ids, -1 for a character without a piece)."""
        keys = left * (1 << 20) + right
        slot = ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - PAIR_BITS)).astype(np.int64)
        ok = (left < 0) | (right < 0)
        known = ok | (self.pair_keys[slot] == keys)
        ok |= known & self.pair_ok[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            fits = np.array([(both := (a := names[key >> 20]) + (b := names[key & 0xFFFFF])) not in self.ids and self.merged(both) == [a, b] for key in new.tolist()])
            ok[miss] = fits[back]
            at = slot[miss]  # one key a slot: a later one takes its place and an earlier one is merged again when met
            self.pair_keys[at], self.pair_ok[at] = keys[miss], fits[back]
        return ok

    # ------------------------------------------------------------ suffix array
    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the piece) of every occurrence of every piece in text (ranks, 0 between words)."""
        n = len(text)
        padded = np.concatenate((text, np.zeros(DEEP, np.uint16))).astype(U64)
        quad = (padded[:n] << U64(48)) | (padded[1 : n + 1] << U64(32)) | (padded[2 : n + 2] << U64(16)) | padded[3 : n + 3]

        def ranked(keys):
            order = np.argsort(keys)
            s = keys[order]
            a, b = ranges(s)
            rank = np.empty(n + DEEP, U64)
            rank[order] = np.repeat(np.arange(1, len(a) + 1).astype(U64), b - a)
            rank[n:] = 0
            return order, s, s[a], rank

        _, s4, u4, r4 = ranked(quad)
        k8 = (r4[:n] << U64(32)) | r4[4 : n + 4]
        _, s8, u8, r8 = ranked(k8)
        order, s16, _, _ = ranked((r8[:n] << U64(32)) | r8[8 : n + 8])  # the suffix array, to the longest piece

        def within(sorted_, lo, hi):
            return np.searchsorted(sorted_, lo, "left"), np.searchsorted(sorted_, hi, "right")

        def exact(unique, key):
            at = np.searchsorted(unique, key)
            return np.where((at < len(unique)) & (unique[np.minimum(at, len(unique) - 1)] == key), at + 1, 0)

        def span8(low, high, length):
            """Keys of depth 8 between which the prefixes of up to 8 characters lie."""
            first = exact(u4, low[:, 0])
            a, b = within(u4, low[:, 1], high[:, 1])
            short = within(u4, low[:, 0], high[:, 0])
            lo = np.where(length > 4, (first << 32) | (a + 1), (short[0] + 1) << 32)
            hi = np.where(length > 4, (first << 32) | b, (short[1] << 32) | 0xFFFFFFFF)
            gone = (length > 4) & ((first == 0) | (b < a + 1))
            return np.where(gone, 1, lo).astype(U64), np.where(gone, 0, hi).astype(U64)

        out = [np.zeros(len(self.piece_len), np.int64), np.zeros(len(self.piece_len), np.int64)]
        g = np.flatnonzero(self.piece_len <= 8)
        lo, hi = span8(self.low[g], self.high[g], self.piece_len[g])
        a, b = within(s8, lo, hi)
        out[0][g], out[1][g] = a, np.maximum(a, b)
        g = np.flatnonzero(self.piece_len > 8)
        if len(g):
            first = exact(u4, self.low[g, 0])
            second = exact(u4, self.low[g, 1])
            eight = np.where((first > 0) & (second > 0), exact(u8, ((first << 32) | second).astype(U64)), 0)
            lo, hi = span8(self.low[g, 2:], self.high[g, 2:], self.piece_len[g] - 8)
            x, y = within(u8, lo, hi)
            ok = (eight > 0) & (y > x)
            a, b = within(s16, np.where(ok, (eight << 32) | (x + 1), 1).astype(U64), np.where(ok, (eight << 32) | y, 0).astype(U64))
            out[0][g], out[1][g] = a, np.maximum(a, b)
        many = out[1] - out[0]
        piece = np.repeat(np.arange(len(many)), many)
        start = order[np.repeat(out[0], many) + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)]
        return start, piece

    # ------------------------------------------------------------ words
    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each word."""
        words = [w.replace(" ", MARK) for w in words]
        points = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(lens + 1) - lens - 1
        text = self.rank[points]
        gap = np.zeros(len(text), bool)
        gap[(begin + lens)[:-1]] = True
        text = np.where(gap, np.uint16(0), text)
        start, piece = self.edges(text)
        ids, size = self.piece_id[piece], self.piece_len[piece]
        single = gap.copy()
        single[start[size == 1]] = True
        odd = np.flatnonzero(~single)  # no piece of their own
        start = np.concatenate((start, odd))
        ids = np.concatenate((ids, np.full(len(odd), -1)))
        size = np.concatenate((size, np.ones(len(odd), np.int64)))
        head = np.repeat(begin, lens + 1)[start]
        step = start + size - head
        order = np.argsort(step.astype(np.uint16) if lens.max() < 1 << 16 else step, kind="stable")  # 16 bits: a radix sort
        start, ids, size, step, head = start[order], ids[order], size[order], step[order], head[order]
        last = np.full(len(text) + 1, -2, np.int64)  # the last piece of the prefix that ends here; -2: none
        names = self._names()
        for a, b in zip(*ranges(step)):
            i, t = start[a:b], ids[a:b]
            left = last[i]
            fresh = i == head[a:b]
            ok = fresh.copy()
            k = np.flatnonzero(~fresh & (left > -2))
            if len(k):
                ok[k] = self.neighbours(left[k], t[k], names)
            # ends are one higher than the last character, so a word's own start is never written
            last[i[ok] + size[a:b][ok]] = t[ok]
        at, live = begin + lens, np.arange(len(words))
        chosen = np.full(len(text) + 1, -2, np.int64)  # the pieces of the way back, by where they end
        while len(live):
            t = last[at[live]]
            if (t == -2).any():
                raise AssertionError("a word was not reached")
            chosen[at[live]] = t
            at[live] -= self.length[t]
            live = live[at[live] > begin[live]]
        end = np.flatnonzero(chosen > -2)
        what = chosen[end]
        first = np.searchsorted(end, begin, side="right")
        first = np.append(first, len(end))
        odd_words = set((np.searchsorted(begin, end[what < 0] - 1, side="right") - 1).tolist())
        flat = what.astype("<i4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for w in odd_words:
            ids_ = []
            for t, e in zip(what[first[w] : first[w + 1]].tolist(), end[first[w] : first[w + 1]].tolist()):
                ids_ += [t] if t >= 0 else [self.byte[x] for x in chr(points[e - 1]).encode("utf-8", "replace")]
            out[w] = np.array(ids_, "<i4").tobytes()
        return out

    def _names(self) -> list[str]:
        if not hasattr(self, "_by_id"):
            self._by_id = [""] * (len(self.bytes_of))
            for p, i in self.ids.items():
                self._by_id[i] = p
        return self._by_id

    def encode(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        split, fresh, size = [], set(), 0

        def settle():
            nonlocal fresh, size, split
            new = list(fresh)
            for k in range(0, len(new), 100_000):
                self.words |= zip(new[k : k + 100_000], self.encode_words(new[k : k + 100_000]))
            get = self.words.__getitem__
            out.extend(b"".join(map(get, ws)) for ws in split)
            fresh, size, split = set(), 0, []
            if len(self.words) > CACHE_WORDS:
                self.words, self.older = {}, self.words

        for t in texts:
            ws = WORD.findall(" " + t) if t else []
            split.append(ws)
            for w in set(ws).difference(self.words, fresh):
                known = self.older.get(w)
                if known is None:
                    fresh.add(w)
                    size += len(w)
                else:
                    self.words[w] = known
            if size > NEW_CHARS:
                settle()
        settle()
        return out

    def decode(self, ids: bytes) -> str:
        i = np.frombuffer(ids, "<i4")
        n = self.size_of[i]
        at = np.repeat(self.start_of[i] - (np.cumsum(n) - n), n)
        text = self.flat[at + np.arange(len(at))].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict = {}
CLEAR.append(_LOADED.clear)


def loaded(key: str, model) -> Pieces:
    """The vocabulary of this worker, kept from task to task."""
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, with_ids: bool = False) -> DataFrame:
    """docs(text, ...) with n_tokens, ids_sha256, decoded_sha256, exact and, if asked for, ids and decoded.

    exact: the decoded text is the text. The model is read by the driver and sent along.
    """
    model = read_model(model_path)
    key = hashlib.sha256(repr(model).encode()).hexdigest()

    def run(batches):
        p = loaded(key, model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                ids = p.encode(texts)
                back = [p.decode(x) for x in ids]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": sha(ids), "decoded_sha256": sha([b.encode() for b in back]), "exact": pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_())}
                if with_ids:
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    new |= {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())), "decoded": pa.array(back, pa.string())}
                yield put_columns(part, new)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] * with_ids
    return docs.mapInArrow(lean("op4")(run), extended(docs.schema, fields))
