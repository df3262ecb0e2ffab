"""Suffix-array dedup by difference-cover blockwise construction.

Removes every byte that a WINDOW-byte string covers which also starts anywhere else (any document, the same one
included; matches never cross documents, and strings are judged on the input). Equal windows are what a suffix array
of the corpus shows as neighbours with a common prefix of WINDOW bytes or more. The array is built a bucket at a time
and never as a whole:

1. *Cover sample.* The suffixes at positions p with p mod 133 in a perfect difference cover (12 residues) are sorted
   bucket by bucket on their first 68 bytes. For any two equal windows i and j some d < 133 puts both i + d and j + d
   in the sample, and the 68 bytes from there lie inside both windows, so a window whose sample suffixes all have
   ranks of their own cannot be repeated: its suffix never enters a bucket.
2. *Long ties.* Samples that share a rank are ranked again by the whole context of the windows they stand for (132
   bytes before to 200 after). Samples that tie here settle all their windows at once, so long repeats, which would
   make deep ties, cost one comparison per sample and not one per suffix.
3. *Blocks of suffixes.* Where a rank has several contexts, one sample of each context sends its suffixes to the
   buckets, which are sorted one at a time by the first WINDOW bytes; equal neighbours are repeated.

Order inside a bucket is by fingerprint (any total order that puts equal strings together will do, and fingerprints
keep frequent beginnings from filling one bucket): 40 bits and the bucket number for the filter of step 1, over 96
bits where a match decides, of two fingerprints with bases and byte tables of their own. Bytes are not compared again.

Nulls are empty texts, texts under WINDOW bytes lose nothing, and repeated rows count as further copies. An empty
table gives an empty table. Extra columns are carried along; result columns replace those of their name in any case.
Memory: a block of half a MB (or the longest text) times about 60, and one bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import MESSAGE, U64, Distinct, Roller, Scratch, Texts, attach, blocks_of, bucket_key, by_block, exchange_counts, extended, from40, lean, lean_group, low40, message_frame, partitions_for, ranges, splitmix, unpack

WINDOW = 200
PERIOD = 133
#: A perfect difference set modulo 133 (every residue is a difference of two of them).
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
GRAM = WINDOW - PERIOD + 1

CONTEXT_MESSAGE = "bucket int, block long, keys binary, contexts binary, counts binary"
WIDE_MESSAGE = "bucket int, block long, keys binary, more binary, counts binary"


def cover_positions(n: int) -> np.ndarray:
    """The cover-sample positions below n, ascending."""
    return (np.arange(n // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).reshape(-1)


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the half-open intervals."""
    if not len(lo):
        return np.zeros(n, bool)
    change = np.bincount(lo, minlength=n + 1).astype(np.int32)
    change -= np.bincount(hi, minlength=n + 1).astype(np.int32)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


class _Samples:
    """Cover-sample positions of a block, with their bucket keys."""

    def __init__(self, blob: bytes, n_buckets: int, seed: int = 11):
        self.table = unpack(blob)
        self.t = t = Texts(self.table)
        self.roll = Roller(t.bytes, seed)
        cover = cover_positions(int(t.lens.max()) if len(t.lens) else 0)
        many = np.where(t.lens >= WINDOW, np.searchsorted(cover, t.lens - GRAM, side="right"), 0)
        self.own = np.repeat(np.arange(len(t.lens)), many)
        self.pos = np.repeat(t.starts, many) + cover[np.arange(len(self.own)) - np.repeat(np.cumsum(many) - many, many)]
        self.begin = t.starts[self.own]
        self.end = self.begin + t.lens[self.own]
        self.distinct = Distinct(bucket_key(self.roll.of(self.pos, self.pos + GRAM), n_buckets))

    def keep(self, codes: np.ndarray) -> None:
        """Only samples whose rank is shared stay."""
        keep = (codes > 0)[self.distinct.inverse] if len(self.pos) else np.zeros(0, bool)
        self.keys = self.distinct.keys[self.distinct.inverse[keep]]
        self.pos, self.own, self.begin, self.end = (x[keep] for x in (self.pos, self.own, self.begin, self.end))
        left, right = np.maximum(self.begin, self.pos - PERIOD + 1), np.minimum(self.end, self.pos + WINDOW)
        self.context = splitmix(self.roll.of(left, right) + splitmix((self.pos - left).astype(U64)))
        order = np.lexsort((self.context, self.keys))
        k, c = self.keys[order], self.context[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.zeros(0, bool)
        self.first = order[new]
        cls = np.cumsum(new) - 1
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = cls
        self.n = np.bincount(cls, minlength=len(self.first))

    def windows(self, sample: np.ndarray) -> np.ndarray:
        """Starts of the windows that the given samples stand for, distinct and sorted."""
        lo, hi = np.maximum(self.begin, self.pos - PERIOD + 1)[sample], np.minimum(self.pos, self.end - WINDOW)[sample]
        some = lo <= hi
        return np.flatnonzero(covered(lo[some], hi[some] + 1, len(self.t.bytes)))


def _ask_ranks(n_buckets: int):
    def ask(frames):
        for f in frames:
            for block, blob in zip(f["block"], f["part"]):
                yield message_frame(list(_Samples(blob, n_buckets).distinct.messages(block)))

    return ask


def _ask_contexts(n_buckets: int):
    def ask(frames):
        for f in frames:
            for block, blob, replies in zip(f["block"], f["part"], f["replies"]):
                if replies is None:
                    continue
                s = _Samples(blob, n_buckets)
                s.keep(s.distinct.answers(replies, n_buckets))
                keys, ctx = s.keys[s.first], s.context[s.first]
                bucket = (keys >> U64(40)).astype(np.int64)
                rows = [(int(bucket[a]), block, low40(keys[a:b]).tobytes(), ctx[a:b].tobytes(), np.minimum(s.n[a:b], 255).astype(np.uint8).tobytes()) for a, b in zip(*ranges(bucket))]
                yield pd.DataFrame(rows, columns=["bucket", "block", "keys", "contexts", "counts"])

    return ask


def _rank_contexts(frame: pd.DataFrame) -> pd.DataFrame:
    """Codes per sample class: 1 settled (context seen elsewhere), 2 sends its suffixes, 3 both."""
    parts = [from40(x) for x in frame["keys"]]
    keys = np.concatenate(parts)
    ctx = np.concatenate([np.frombuffer(x, U64) for x in frame["contexts"]])
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["counts"]]).astype(np.int64)
    order = np.lexsort((ctx, keys))
    k, c = keys[order], ctx[order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    new_c = new_k | np.concatenate(([True], c[1:] != c[:-1]))
    cls = np.cumsum(new_c) - 1
    times = np.bincount(cls, weights=n[order]).astype(np.int64)
    classes_of_key = np.bincount(np.cumsum(new_k) - 1, weights=new_c).astype(np.int64)[np.cumsum(new_k) - 1]
    codes = np.empty(len(keys), np.uint8)
    codes[order] = (times[cls] > 1) + 2 * (new_c & (classes_of_key > 1))
    at = np.cumsum([0, *map(len, parts)])
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "codes": [codes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]})


def _codes(replies) -> np.ndarray:
    return np.frombuffer(b"".join(r["codes"] for r in sorted(replies, key=lambda r: r["bucket"])), np.uint8) if replies is not None else np.zeros(0, np.uint8)


class _Wide:
    """Distinct WINDOW-byte fingerprints (64 and 32 bits) of the suffixes that a block sends."""

    def __init__(self, s: _Samples, starts: np.ndarray, n_buckets: int):
        self.starts = starts
        h = s.roll.of(starts, starts + WINDOW)
        g = Roller(s.t.bytes, 29, Roller.SECOND).of(starts, starts + WINDOW) >> U64(32)
        bucket = (h >> U64(32)) % U64(n_buckets)
        order = np.lexsort((g, h, bucket))
        hb, hh, gg = bucket[order], h[order], g[order]
        new = np.concatenate(([True], (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1]))) if len(order) else np.zeros(0, bool)
        cls = np.cumsum(new) - 1
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = cls
        self.bucket, self.h, self.g = hb[new].astype(np.int64), hh[new], gg[new].astype(np.uint32)
        self.n = np.minimum(np.bincount(cls, minlength=len(self.h)), 255).astype(np.uint8)


def _ask_windows(n_buckets: int):
    def ask(frames):
        for f in frames:
            for block, blob, r1, r2 in zip(f["block"], f["part"], f["replies"], f["contexts"]):
                if r2 is None:
                    continue
                s = _Samples(blob, n_buckets)
                s.keep(s.distinct.answers(r1, n_buckets))
                w = _Wide(s, s.windows(s.first[(_codes(r2) & 2) > 0]), n_buckets)
                rows = [(int(w.bucket[a]), block, w.h[a:b].tobytes(), w.g[a:b].tobytes(), w.n[a:b].tobytes()) for a, b in zip(*ranges(w.bucket))]
                yield pd.DataFrame(rows, columns=["bucket", "block", "keys", "more", "counts"])

    return ask


def _sort_suffixes(frame: pd.DataFrame) -> pd.DataFrame:
    h = np.concatenate([np.frombuffer(x, U64) for x in frame["keys"]])
    g = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["more"]])
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["counts"]]).astype(np.int64)
    order = np.lexsort((g, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
    cls = np.cumsum(new) - 1
    codes = np.empty(len(h), np.uint8)
    codes[order] = np.bincount(cls, weights=n[order])[cls] > 1
    at = np.cumsum([0, *(len(x) for x in frame["counts"])])
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "codes": [np.packbits(codes[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])], "n": np.diff(at)})


def _bits(replies) -> np.ndarray:
    if replies is None:
        return np.zeros(0, np.uint8)
    return np.concatenate([np.unpackbits(np.frombuffer(r["codes"], np.uint8), count=r["n"]) for r in sorted(replies, key=lambda r: r["bucket"])])


def _finish(n_buckets: int, names: list[str], out_text: bool):
    def finish(batches):
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "n_bytes"}
            for blob, r1, r2, r3 in zip(cols["part"], cols["replies"], cols["contexts"], cols["windows"]):
                s = _Samples(blob, n_buckets)
                t = s.t
                gone = np.zeros(len(t.bytes), bool)
                if r2 is not None:
                    s.keep(s.distinct.answers(r1, n_buckets))
                    codes = _codes(r2)
                    repeated = [s.windows(np.flatnonzero((codes & 1)[s.cls]))]
                    w = _Wide(s, s.windows(s.first[(codes & 2) > 0]), n_buckets)
                    bits = _bits(r3)
                    if len(bits):
                        repeated.append(w.starts[bits[w.cls] > 0])
                    starts = np.concatenate(repeated)
                    gone = covered(starts, starts + WINDOW, len(gone))
                first_byte = np.zeros(len(t.bytes), bool)
                first_byte[t.starts[t.lens > 0]] = True
                opens = gone & (first_byte | ~np.concatenate(([False], gone[:-1])))
                removed, spans = (c[t.starts + t.lens] - c[t.starts] for c in (np.concatenate(([0], np.cumsum(x))) for x in (gone, opens)))
                shas, texts = [], []
                for a, n, r in zip(t.starts.tolist(), t.lens.tolist(), removed.tolist()):
                    piece = t.bytes[a : a + n]
                    kept = (piece if not r else piece[~gone[a : a + n]]).tobytes()
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if out_text:
                        texts.append(kept.decode("utf-8", "ignore"))
                new = {"n_bytes": pa.array(t.lens, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
                if out_text:
                    new["kept_text"] = pa.array(texts, pa.string())
                have = {n: s.table.column(n) for n in s.table.schema.names}
                yield from pa.table({c: new[c] if c in new else have[c] for c in names}).to_batches(max_chunksize=2000)

    return finish


def suffix_dedup(spark: SparkSession, docs: DataFrame, with_text: bool = False, with_original: bool = True) -> DataFrame:
    """docs(text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    kept_text leaves out characters of which bytes were removed; kept_sha256 is over the bytes. with_original=False leaves
    text itself out of the result, so that each text is written once.
    """
    with Scratch(spark) as scratch:
        blocks = blocks_of(scratch, docs)
        n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        b = partitions_for(spark, n_bytes)
        r1 = exchange_counts(blocks.mapInPandas(lean("op2")(_ask_ranks(b)), MESSAGE))
        r1 = scratch.write(r1, "ranks")
        one = attach(blocks, r1)
        r2 = by_block(one.mapInPandas(lean("op2")(_ask_contexts(b)), CONTEXT_MESSAGE).groupBy("bucket").applyInPandas(lean_group(_rank_contexts), "block long, bucket int, codes binary"))
        r2 = scratch.write(r2.withColumnRenamed("replies", "contexts"), "contexts")
        two = attach(one, r2)
        r3 = by_block(two.mapInPandas(lean("op2")(_ask_windows(b)), WIDE_MESSAGE).groupBy("bucket").applyInPandas(lean_group(_sort_suffixes), "block long, bucket int, codes binary, n int"))
        r3 = scratch.write(r3.withColumnRenamed("replies", "windows"), "windows")
        new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())] + [("kept_text", T.StringType())] * with_text
        schema = extended(docs.schema, [T.StructField(n, t) for n, t in new])
        if not with_original:
            schema = T.StructType([f for f in schema.fields if f.name != "text"])
        return scratch.result(attach(two, r3).mapInArrow(lean("op2")(_finish(b, schema.names, with_text)), schema))
