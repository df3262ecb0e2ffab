"""External models behind an interface: a cache keyed by content decides what is sent to them at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in without a model: signed hashed words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dims] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed(df: DataFrame, text: Column, provider: Callable[[list[str]], list[list[float]]] | None = None, column: str = "embedding") -> DataFrame:
    """One Arrow batch a call; null texts have no vector."""
    provider = provider or hashing_embedder()

    @F.pandas_udf("array<float>")
    def call(s: pd.Series) -> pd.Series:
        have = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if have.any():
            out[have] = pd.Series(provider(s[have].tolist()), index=s.index[have])
        return out

    return df.withColumn(column, call(text))


def apply_cached(df: DataFrame, cache: DataFrame, key: str, digest: Column, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results for df from cache(key, digest, result); only rows without a cached result of their digest go to call,
    which adds the column result. Returns (key, digest, result) of df and the new rows of the cache."""
    rows = df.withColumn("digest", digest)
    known = rows.select(key, "digest").join(cache.select(key, "digest", "result"), [key, "digest"])
    new = call(rows.join(cache.select(key, "digest"), [key, "digest"], "left_anti")).select(key, "digest", "result")
    return known.select(key, "digest", "result").unionByName(new), new


# ---------------------------------------------------------------- contracts of the other models
def classify(df: DataFrame, cache: DataFrame, key: str, digest: Column, directions, call: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised answers (key, digest, result) of df(key, title, abstract, venue), and what is new in the cache.

    Only rows without a cached answer of their digest go to call, which adds `result`, a JSON text; without a call the
    local rules answer, and nothing of theirs is cached."""
    from paperloom.functions import cards

    local = lambda d: d.withColumn("result", F.to_json(cards.heuristic_classification(F.col("title"), F.col("abstract"), F.col("venue"))))
    out, new = apply_cached(df, cache, key, digest, call or local)
    return out.withColumn("result", cards.normalize_classification(F.col("result"), directions)), new if call else new.where("false")


def ask_each(df: DataFrame, prompt: Column, provider: Callable[[str], str], attempts: int = 4, pool: int = 8, column: str = "answer") -> DataFrame:
    """One call a row, `pool` at a time in each task; after the last failed attempt the answer is null. Null prompts
    aren't sent."""

    @F.pandas_udf("string")
    def call(s: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        def one(text):
            for _ in range(attempts if isinstance(text, str) else 0):
                try:
                    return provider(text)
                except Exception:
                    continue
            return None

        with ThreadPoolExecutor(pool) as threads:
            return pd.Series(list(threads.map(one, s)), index=s.index, dtype=object)

    return df.withColumn(column, call(prompt))


#: How often a chunk is halved at most, and the length under which it isn't.
HALVINGS, LEAST_CHUNK = 3, 1800


def translate_chunk(chunk: str, provider: Callable[[str], str], depth: int = 0) -> str:
    """A translated chunk. What must not change is hidden behind tokens; if the answer lost or invented one, or failed,
    the chunk is halved at a block border and both halves are tried; a chunk that can't be halved raises."""
    from paperloom.operators import documents as doc

    hidden, kept = doc.protect(chunk)
    error = "tokens changed"
    try:
        answer = provider(hidden)
        outer = [t for t, _ in kept if t in hidden]
        if all(answer.count(t) == 1 for t in outer) and len(TOKENS.findall(answer)) == len(outer):
            return doc.restore(answer, kept)
    except Exception as e:
        error = str(e)
    parts = doc.blocks(chunk)
    if depth >= HALVINGS or len(chunk) < LEAST_CHUNK or len(parts) < 2:
        raise ValueError(f"chunk not translated: {error}")
    half, size = 1, len(parts[0])
    while half < len(parts) - 1 and size < len(chunk) / 2:
        size += len(parts[half])
        half += 1
    return "\n\n".join(translate_chunk("\n\n".join(p), provider, depth + 1) for p in (parts[:half], parts[half:]))


TOKENS = re.compile(r"\[\[PL_[A-Z]+_\d{6}\]\]")


def translate_title(title: str, provider: Callable[[str], str]) -> str | None:
    """The first line of the answer, without quotes and marks; null if it has no Chinese character."""
    lines = [x.strip().strip("#*\"'“”《》 ") for x in (provider(title) or "").splitlines() if x.strip()]
    return lines[0] if lines and re.search("[一-鿿]", lines[0]) else None


#: Objects in one review, kinds that may be answered, and the confidence that an answer may have.
REVIEWED, KINDS, CONFIDENCE = 24, ("figure", "table", "table_image", "unknown"), (0.65, 0.99)


class Decision(NamedTuple):
    """What a reviewer says of an object: its kind, how sure that is, and the caption that belongs to it, if any."""

    id: str
    kind: str
    confidence: float
    caption_id: str | None = None


def review_bindings(ambiguous, captions, provider: Callable[[list[dict]], list[dict]], clamp: bool = False) -> list:
    """Decisions on ambiguous objects, asked for in batches; ids, kinds and captions that weren't offered are dropped.

    clamp: a visual reviewer's confidence is kept between .65 and .99."""
    ids, known, out = {o.id for o in ambiguous}, {c.id for c in captions}, []
    offered = [{"id": o.id, "kind": o.kind, "captions": [{"id": c.id, "text": c.text} for c in captions]} for o in ambiguous]
    for k in range(0, len(offered), REVIEWED):
        for a in provider(offered[k : k + REVIEWED]) or []:
            if a.get("id") not in ids or a.get("kind") not in KINDS:
                continue
            sure = float(a.get("confidence") or 0)
            sure = min(CONFIDENCE[1], max(CONFIDENCE[0], sure)) if clamp else max(0.0, min(1.0, sure))
            out.append(Decision(a["id"], a["kind"], sure, a.get("caption_id") if a.get("caption_id") in known else None))
    return out


def first_reviewer(reviewers, *arguments):
    """The answer of the first reviewer, in the order of preference, that has one."""
    for reviewer in reviewers:
        try:
            if (answer := reviewer(*arguments)) is not None:
                return answer
        except Exception:
            continue
    return []
