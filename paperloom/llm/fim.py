"""Fill-in-the-middle by a parallel automaton scan: units of a text are counted and cut without reading it in order.

A finite automaton over the bytes of UTF-8 says where units (lines; sentences) end. A text is cut into chunks whose entry
states nobody knows yet; each chunk emits its transition function (the state it ends in, for each state it may start
in) and, per start state, the units that end in it. Functions with counts compose associatively, so the entry states and
the counts before all chunks come from a scan of log2(chunks) steps, and the chunk that holds the end of the k-th unit
is selected by binary search; only that chunk is walked again, from its entry state.

Texts of up to `piece_bytes` are scanned within a row of a batch, all chunks of a batch at once; nothing is shuffled.
Longer ones are split into pieces that are rows of their own and spread over all tasks: each task emits the functions of
its pieces, columns compose them (a text of 2 GB, the limit of a cell, has 8,192 of them), and each cut is looked for in
the one piece that holds it. The answer does not depend on the sizes of chunks and pieces.

A null text is empty, an empty one has no units and stays plain, and so does a text that holds a mark already, which makes
the output reversible: `restored` needs only the output and its form. Rows of one id are judged by their own texts;
repeated rows get equal results; a null id draws like an empty one. An empty table gives an empty table, extra columns stay
(result columns replace namesakes in any case).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Texts, lean

CHUNK_BYTES = 256
PIECE_BYTES = 1 << 18
PART_ROWS = 256
MARKS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class Automaton(NamedTuple):
    """kinds: class of each byte; step, done: by class and state, the next state and the units that end with this byte;
    last: by state, the units that end with the text. State 0 begins a text. Units must end at characters' ends."""

    kinds: bytes
    step: tuple[tuple[int, ...], ...]
    done: tuple[tuple[int, ...], ...]
    last: tuple[int, ...]


def _kinds(*classes: bytes) -> bytes:
    out = bytearray(256)
    for k, members in enumerate(classes, 1):
        for b in members:
            out[b] = k
    return bytes(out)


#: `[^\n]*\n|[^\n]+`; states: before a line, in a line.
LINES = Automaton(_kinds(b"\n"), ((1, 1), (0, 0)), ((0, 0), (1, 1)), (0, 1))
#: Up to white space after a full stop, question or exclamation mark; states: before, in a sentence, after its stop.
SENTENCES = Automaton(_kinds(b".?!", b" \t\r\n"), ((1, 1, 1), (2, 2, 2), (1, 1, 0)), ((0, 0, 0), (0, 0, 0), (0, 0, 1)), (0, 1, 1))


class Scan:
    """Functions and counts of the chunks of many texts, composed up to each chunk (from any start state of its text)."""

    def __init__(self, a: Automaton, data: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        self.a, self.states, self.pad = a, len(a.last), len(a.step)
        same = tuple(range(self.states))
        self.step = np.array([*a.step, same], np.uint8).reshape(-1)
        self.done = np.array([*a.done, (0,) * self.states], np.uint8).reshape(-1)
        self.kinds, self.data, self.starts, self.lens = np.frombuffer(a.kinds, np.uint8), data, starts, lens
        chunks = -(-lens // CHUNK_BYTES)
        self.first = np.cumsum(chunks) - chunks
        self.own = np.repeat(np.arange(len(lens)), chunks)
        self.at = starts[self.own] + (np.arange(len(self.own)) - self.first[self.own]) * CHUNK_BYTES
        self.end = (starts + lens)[self.own]
        ends, counts = [], []
        for k in range(0, len(self.own), 4096):
            e, c = self._functions(slice(k, k + 4096))
            ends.append(e)
            counts.append(c)
        self.ends = np.concatenate(ends, axis=1) if ends else np.zeros((self.states, 0), np.uint8)
        self.counts = np.concatenate(counts, axis=1) if counts else np.zeros((self.states, 0), np.int64)
        self._compose()

    def _classes(self, chunks) -> np.ndarray:
        """The classes of the bytes of some chunks, a row for each place in the chunk; behind the text nothing happens."""
        at, end = self.at[chunks], self.end[chunks]
        where = at[None, :] + np.arange(CHUNK_BYTES)[:, None]
        got = self.kinds[self.data[np.minimum(where, len(self.data) - 1)]]
        return np.where(where < end[None, :], got, self.pad).astype(np.int64) * self.states

    def _functions(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        rows = self._classes(chunks)
        state = np.repeat(np.arange(self.states)[:, None], rows.shape[1], axis=1)
        count = np.zeros(state.shape, np.int64)
        for row in rows:
            k = row + state
            count += self.done[k]
            state = self.step[k]
        return state.astype(np.uint8), count

    def _compose(self) -> None:
        step = 1
        while len(self.own) > step and (self.own[step:] == self.own[:-step]).any():
            later = np.flatnonzero(self.own[step:] == self.own[:-step]) + step
            via = self.ends[:, later - step]
            self.counts[:, later] = self.counts[:, later - step] + self.counts[via, later]
            self.ends[:, later] = self.ends[via, later]
            step *= 2

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of whole texts, by start state."""
        ends = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], len(self.lens), axis=1)
        counts = np.zeros(ends.shape, np.int64)
        some = np.flatnonzero(self.lens > 0)
        tail = self.first[some] + -(-self.lens[some] // CHUNK_BYTES) - 1
        ends[:, some], counts[:, some] = self.ends[:, tail], self.counts[:, tail]
        return ends, counts

    def select(self, text: np.ndarray, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes of each text up to the end of its k-th unit (k >= 1), with the state it begins in; the whole text if
        fewer end in it."""
        out = self.lens[text].copy()
        if not len(self.own):
            return out
        for s in range(self.states):
            high = int(self.counts[s].max()) + 1
            keys = self.own * high + self.counts[s]
            q = np.flatnonzero(start == s)
            chunk = np.searchsorted(keys, text[q] * high + np.minimum(k[q], high - 1))
            ok = (k[q] < high) & (chunk < len(self.own))
            ok[ok] = self.own[chunk[ok]] == text[q][ok]
            q, chunk = q[ok], chunk[ok]
            inner = chunk > self.first[text[q]]
            state, before = np.full(len(q), s), np.zeros(len(q), np.int64)
            state[inner], before[inner] = self.ends[s, chunk[inner] - 1], self.counts[s, chunk[inner] - 1]
            for a in range(0, len(q), 4096):
                b = slice(a, a + 4096)
                out[q[b]] = self.at[chunk[b]] - self.starts[text[q[b]]] + self._walk(chunk[b], state[b], k[q[b]] - before[b])
        return out

    def _walk(self, chunks, state, k) -> np.ndarray:
        found, count = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for j, row in enumerate(self._classes(chunks), 1):
            at = row + state
            count += self.done[at]
            state = self.step[at]
            found[(count >= k) & (found == 0)] = j
        return found


class _Chars:
    """How many code points begin before a byte."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))

    def __call__(self, a, b) -> np.ndarray:
        return self.sums[b] - self.sums[a]


class _Pieces:
    """The pieces of a batch as one byte array; a piece may begin or end inside a character."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
        self.starts, self.lens = ends[:-1] - ends[0], np.diff(ends)


def _parts(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(k, PART_ROWS)


def _numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut_small(a: Automaton):
    def cut(batches):
        for part in _parts(batches):
            t = Texts(pa.Table.from_batches([part]))
            scan, chars = Scan(a, t.bytes, t.starts, t.lens), _Chars(t.bytes)
            ends, counts = scan.functions()
            n = counts[0] + np.array(a.last)[ends[0]]
            draws = [_numbers(part, h) % (n + 1) for h in ("h1", "h2")]
            out = {"aside": part.column(part.schema.get_field_index("aside")), "text": part.column(part.schema.get_field_index("text")), "n": pa.array(n, pa.int64())}
            for name, k in (("p1", np.minimum(*draws)), ("p2", np.maximum(*draws))):
                some = np.flatnonzero(k > 0)
                upto = np.zeros(len(k), np.int64)
                upto[some] = scan.select(some, np.zeros(len(some), np.int64), k[some])
                out[name] = pa.array(chars(t.starts, t.starts + upto), pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return cut


def _piece_functions(a: Automaton):
    def scan_pieces(batches):
        for part in _parts(batches):
            t = _Pieces(part.column(part.schema.get_field_index("piece")))
            ends, counts = Scan(a, t.bytes, t.starts, t.lens).functions()
            out = {c: part.column(part.schema.get_field_index(c)) for c in ("key", "no")}
            out |= {"ends": pa.array(ends.T.astype(np.int32).tolist(), pa.list_(pa.int32())), "counts": pa.array(counts.T.tolist(), pa.list_(pa.int64()))}
            out["chars"] = pa.array(_Chars(t.bytes)(t.starts, t.starts + t.lens), pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return scan_pieces


def _select_in_pieces(a: Automaton):
    def select(batches):
        for part in _parts(batches):
            t = _Pieces(part.column(part.schema.get_field_index("piece")))
            upto = Scan(a, t.bytes, t.starts, t.lens).select(np.arange(len(t.lens)), _numbers(part, "state"), _numbers(part, "k"))
            before = _numbers(part, "before") + _Chars(t.bytes)(t.starts, t.starts + upto)
            out = {c: part.column(part.schema.get_field_index(c)) for c in ("key", "cut")}
            yield pa.RecordBatch.from_pydict(out | {"at": pa.array(before, pa.int64())})

    return select


def _cut_giants(a: Automaton, rows: DataFrame, piece_bytes: int) -> DataFrame:
    """rows(aside, text, h1, h2) of long texts with n, p1 and p2; a row is known by its draws and its text."""
    rows = rows.withColumn("key", F.sha2(F.concat_ws(":", "h1", "h2", "text"), 256))
    cut = f"substring(CAST(text AS BINARY), CAST(no * {piece_bytes} + 1 AS INT), {piece_bytes})"
    pieces = rows.select("key", "h1", "h2", "text", F.expr(f"explode(sequence(0, CAST((octet_length(text) - 1) div {piece_bytes} AS INT)))").alias("no"))
    pieces = pieces.select("key", "h1", "h2", "no", F.expr(cut).alias("piece"))
    text = F.col("piece").cast("binary").alias("piece")
    one = pieces.select("key", "no", text).repartition("key", "no").mapInArrow(lean("op12")(_piece_functions(a)), "key string, no int, ends array<int>, counts array<long>, chars long")
    one = one.groupBy("key", "no").agg(*[F.first(c).alias(c) for c in ("ends", "counts", "chars")])  # of rows alike
    whole = one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ends", "counts", "chars"))).alias("all"))
    entry = "array<struct<no: int, state: int, units: bigint, chars: bigint, found: bigint>>"
    follow = "named_struct('no', x.no, 'state', acc.now.ends, 'units', acc.now.units, 'chars', acc.now.chars, 'found', x.counts[acc.now.ends])"
    fold = f"""aggregate(all,
      named_struct('now', named_struct('ends', 0, 'units', 0L, 'chars', 0L), 'list', CAST(array() AS {entry})),
      (acc, x) -> named_struct(
        'now', named_struct('ends', x.ends[acc.now.ends], 'units', acc.now.units + x.counts[acc.now.ends], 'chars', acc.now.chars + x.chars),
        'list', array_append(acc.list, {follow})))"""
    folded = whole.select("key", F.expr(fold).alias("f"))
    last = F.get(F.array(*map(F.lit, a.last)), F.col("f.now.ends"))
    folded = folded.select("key", "f.list", F.col("f.now.chars").alias("chars"), (F.col("f.now.units") + last).alias("n"))
    draws = rows.select("key", "h1", "h2").distinct().join(folded, "key")
    draws = draws.withColumns({"a": F.col("h1") % (F.col("n") + 1), "b": F.col("h2") % (F.col("n") + 1)})
    cuts = draws.select("key", "n", "chars", "list", F.posexplode(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("cut", "k"))
    hit = F.get(F.filter("list", lambda x: (x["units"] < F.col("k")) & (F.col("k") <= x["units"] + x["found"])), F.lit(0))
    cuts = cuts.select("key", "n", "cut", "k", "chars", hit.alias("hit"))
    inside = cuts.where("hit IS NOT NULL").select("key", "cut", F.col("hit.no").alias("no"), F.col("hit.state").alias("state"), (F.col("k") - F.col("hit.units")).alias("k"), F.col("hit.chars").alias("before"))
    found = pieces.select("key", "no", text).dropDuplicates(["key", "no"]).join(inside, ["key", "no"])
    found = found.mapInArrow(lean("op12")(_select_in_pieces(a)), "key string, cut int, at long")
    ends = cuts.join(found, ["key", "cut"], "left").withColumn("at", F.coalesce("at", F.when(F.col("k") > 0, F.col("chars")), F.lit(0)))
    ends = ends.groupBy("key").agg(F.first("n").alias("n"), F.min("at").alias("p1"), F.max("at").alias("p2"))
    return rows.join(ends, "key").select("aside", "text", "n", "p1", "p2")


def draw(column: Column, seed: int, k: int) -> Column:
    """The k-th group of 8 hex digits of the sha256 of seed:id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from an output and its form alone."""
    p, s, m = marks
    head = lambda c, mark: F.substring_index(c, mark, 1)
    tail = lambda c, mark: F.substr(c, F.char_length(head(c, mark)) + F.lit(len(mark) + 1))
    psm = F.substr(output, F.lit(len(p) + 1))
    spm = F.substr(output, F.lit(len(s) + 1))
    by_psm = F.concat(head(psm, s), tail(tail(psm, s), m), head(tail(psm, s), m))
    by_spm = F.concat(head(tail(spm, p), m), tail(tail(spm, p), m), head(spm, p))
    return F.when(form == "psm", by_psm).when(form == "spm", by_spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, automaton: Automaton = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS,
    piece_bytes: int = PIECE_BYTES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output. percent of the texts are transformed, spm_percent of
    these begin with the suffix; which ones, and where they are cut, hangs on seed and id only."""
    others = [c for c in docs.columns if c.lower() not in RESULTS and c != text]
    held = [F.col(c) for c in others] or [F.lit(None).cast("int").alias("nothing")]
    draws = [draw(F.col(key), seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)]
    aside = F.struct(F.struct(*held).alias("row"), F.col(text).isNull().alias("missing"), draws[2], draws[3]).alias("aside")
    rows = docs.select(aside, F.coalesce(text, F.lit("")).alias("text"), *draws[:2])
    small = rows.where(F.octet_length("text") <= piece_bytes)
    ddl = f"aside {rows.schema['aside'].dataType.simpleString()}, text string, n long, p1 long, p2 long"
    schema = small.withColumns({c: F.lit(0).cast("long") for c in ("n", "p1", "p2")}).drop("h1", "h2").schema if others else ddl
    out = small.mapInArrow(lean("op12")(_cut_small(automaton)), schema)
    out = out.unionByName(_cut_giants(automaton, rows.where(F.octet_length("text") > piece_bytes), piece_bytes))
    marked = reduce(lambda x, y: x | y, [F.contains("text", F.lit(m)) for m in marks])
    plain = (F.col("text") == "") | marked | (F.col("aside.h3") % 100 >= percent)
    out = out.withColumn("form", F.when(plain, "plain").when(F.col("aside.h4") % 100 < spm_percent, "spm").otherwise("psm"))
    prefix, middle, suffix = F.substr("text", F.lit(1), F.col("p1").cast("int")), F.substr("text", (F.col("p1") + 1).cast("int"), (F.col("p2") - F.col("p1")).cast("int")), F.substr("text", (F.col("p2") + 1).cast("int"))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    cut = F.col("form") != "plain"
    new = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(cut, F.col("p1")), "middle_chars": F.when(cut, F.col("p2") - F.col("p1")), "output": output}
    old = [F.when(~F.col("aside.missing"), F.col("text")).alias(c) if c == text else F.col("aside.row")[c].alias(c) for c in docs.columns if c in others or c == text]
    return out.select(*old, *[c.alias(n) for n, c in new.items()])
