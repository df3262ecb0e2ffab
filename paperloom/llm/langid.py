"""Language ID by n-gram filters whose slots are bitmasks of languages.

One Bloom filter per language, bit-sliced: slot k holds the bits of all languages, so that two lookups and an AND
tell at once which languages contain an n-gram. Each language's popcount over a text is corrected for the chance that
its filter answers yes to an n-gram it never saw, and the largest corrected count decides.

N-grams are three code points around every letter, lower-cased one by one; anything but a letter is a word border.
Training reads SAMPLE labelled documents per language at most (those with the smallest hash of their id; a parameter
of fit) and keeps every n-gram of theirs; the filters have SLOTS_EACH slots for each n-gram of the richest language.
Rows far from the sample are left out by a threshold on the hash before anything is moved, so no task meets more than
a few thousand rows of one language. There may be MOST_LANGUAGES languages; more raise an error. Prediction reads every
text as a whole, in stretches of a million code points.

Texts that are null or have no letter are `und` with score 0; so is everything if no labelled row exists. Ties go to
the first language in code point order. Repeated rows get equal answers; an empty table gives an empty table; extra
columns stay, and result columns replace columns of the same name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import U64, extended, lean, put_columns, splitmix

SAMPLE, SLOTS_EACH, MOST_LANGUAGES = 500, 8, 256
STRETCH = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Lower case of every code point that is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the index of the text of each."""
    raw = [("" if t is None else t) for t in texts]
    points = np.frombuffer("\0".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32) if raw else np.zeros(0, np.uint32)
    low = _letters()[np.concatenate((np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)))].astype(U64)
    at = np.flatnonzero(low)
    ends = np.cumsum([len(t) + 1 for t in raw])
    return splitmix((low[at - 1] << U64(42)) | (low[at] << U64(21)) | low[at + 1]), np.searchsorted(ends, at, side="left")


def stretches(texts: list, limit: int = STRETCH):
    """Groups of (text number, piece) of up to limit code points together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, len(t) if t else 0, limit):
            held.append((i, t[k : k + limit]))
            size += len(held[-1][1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


class Model:
    """Languages in code point order and the bit-sliced filter."""

    def __init__(self, by_language: dict[str, np.ndarray], slots: int | None = None):
        self.languages = sorted(by_language)
        self.slots = slots = slots or 1 << max(12, (SLOTS_EACH * max(map(len, by_language.values()), default=1) - 1).bit_length())
        self.masks = np.zeros((max(1, -(-len(self.languages) // 8)), slots), np.uint8)
        for k, lang in enumerate(self.languages):
            for s in self._slots(by_language[lang]):
                self.masks[k // 8][s] |= np.uint8(1 << k % 8)
        fill = [(self.masks[k // 8] >> np.uint8(k % 8) & 1).mean() for k in range(len(self.languages))]
        self.false = np.array(fill) ** 2
        self.bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def _slots(self, h: np.ndarray):
        return (h % U64(self.slots)).astype(np.int64), ((h >> U64(32)) % U64(self.slots)).astype(np.int64)

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and the corrected count of each language."""
        n, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), 8 * len(self.masks)), np.int64)
        for held in stretches(texts):
            doc = np.array([i for i, _ in held])
            h, own = grams([p for _, p in held])
            n += np.bincount(doc[own], minlength=len(texts))
            a, b = self._slots(h)
            for w, masks in enumerate(self.masks):
                seen = np.bincount(own * 256 + (masks[a] & masks[b]), minlength=256 * len(doc)).reshape(len(doc), 256)
                np.add.at(hits[:, 8 * w : 8 * w + 8], doc, seen @ self.bits)
        hits = hits[:, : len(self.languages)]
        return n, np.maximum(0, (hits - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))

    def predict(self, texts: list) -> tuple[list[str], list[float], np.ndarray]:
        """Language, score (its share of all corrected counts) and known share (of its n-grams) per text."""
        n, c = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), np.zeros(len(texts))
        best, total = c.argmax(axis=1), c.sum(axis=1)
        top = c[np.arange(len(c)), best]
        score = np.where(total > 0, top / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, n)], np.where(n > 0, score, 0.0).tolist(), np.where(n > 0, np.minimum(1, top / np.maximum(n, 1)), 0.0)


def _distinct(frames):
    for f in frames:
        for lang, part in f.groupby("lang"):
            for held in stretches(part["text"].tolist()):
                yield pd.DataFrame({"lang": lang, "gram": np.unique(grams([p for _, p in held])[0].view(np.int64))})


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, slots: int | None = None) -> Model:
    """A model of docs(doc_id, text, lang), all of whose rows may be learned from."""
    docs = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    many = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(many) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    top = 1 << 40
    limits = [F.lit(x) for lang, n in many.items() if n > 4 * sample for x in (lang, top * 4 * sample // n)]  # keeps about 4 * sample rows
    h = F.pmod(F.xxhash64("doc_id"), F.lit(top))
    near = docs.withColumn("h", h).where(F.col("h") < (F.coalesce(F.element_at(F.create_map(*limits), F.col("lang")), F.lit(top)) if limits else F.lit(top)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    texts = near.withColumn("r", rank).where(F.col("r") <= sample).select("text", "lang")
    rows = texts.mapInPandas(lean("op1")(_distinct), "lang string, gram long").distinct().toPandas()
    return Model({lang: part["gram"].to_numpy(np.int64).view(U64) for lang, part in rows.groupby("lang")}, slots)


def identify(docs: DataFrame, model: Model, known: bool = False) -> DataFrame:
    """docs(text, ...) with lang_pred and score, and known_share if asked for."""

    def predict(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            lang, score, share = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            yield put_columns(batch, new | ({"known_share": pa.array(share, pa.float64())} if known else {}))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("known_share", T.DoubleType())] * known
    return docs.mapInArrow(lean("op1")(predict), extended(docs.schema, fields))
