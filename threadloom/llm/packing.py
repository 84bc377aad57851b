"""Packing of documents into sequences of a fixed window, by a histogram of lengths.

A document of n tokens (the end token included) gives n // window full sequences and a rest of n % window tokens.
The histogram of the rests, window counts whatever the table's size, is all that the driver sees:

1. combinations of two and three lengths that fill the window exactly are enumerated;
2. non-negative least squares gives how often each is used, so that together they use up the histogram;
3. these numbers are rounded and taken as far as the rests suffice;
4. what is left is packed greedily, the longest rests that fit first, wherever that fills a window; what
   fills none follows one another, longest first, and is cut at the windows' ends.  The last window - 1 tokens at
   most go to sequences of a power of two.

So no sequence is padded, and only residuals are cut.  The plan is a list of intervals for each length: rests number
k to l go to sequences s, s + 1, ... at an offset.  A rest finds its number by a count in its task and the
counts of the tasks before; no group of documents meets anywhere.

Tokens are those of the `tokenizers` library; their strings for special tokens are ordinary text.  A text is cut
between a character that isn't white space and a single space before another such one, where this
pre-tokenizer always cuts.  Words with letters beyond U+024F are encoded by the library, once a worker while it
remembers them; all else by `tiktoken` with the ranks of the same file, which gives the same ids many times faster.

Defined results: a null text is empty and gives the end token alone; a null id is an id like others;
repeated rows are documents of their own; an empty table gives no rows; texts are encoded whole, however
long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.held import held
from threadloom.workspace import materialize, small_batches

WINDOW = 1024
#: Rounds of the solver; fewer if no number of uses would still change by half.
STEPS = 400
#: Words that a worker remembers, and their length.
WORDS, LONG = 1 << 17, 48
END = b"\0\0\0\0"

#: Characters of a text that are encoded at once, and those beyond which two libraries' tables of letters may differ.
CHUNK = 1 << 20
_RARE = re.compile("[^\x00-\u024f]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token of a byte-level BPE -> its rank; None if the file asks for more than merges in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or made.get("normalizer") or not plain or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # stand for themselves; the others follow 255
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    extra = {t["content"] for t in made.get("added_tokens", [])}
    if merged != list(range(256, 256 + len(merged))) or len(vocabulary.keys() - extra) != 256 + len(merged):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in extra}


class _Known(dict):
    """word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONG:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of the `tokenizers` library; where its file has nothing but ranks, a second library merges by these, many times faster."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.vocabulary, self.library, known = tokenizer.get_vocab_size(), _Known(tokenizer), ranks(path)
        self.merger = known and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> bytes:
        if len(text) <= CHUNK:
            return self._ids(text)
        out, at = [], 0
        while at < len(text):
            end = _BETWEEN.search(text, at + CHUNK)
            to = end.start() if end else len(text)
            out.append(self._ids(text[at:to]))
            at = to
        return b"".join(out)

    def _ids(self, text: str) -> bytes:
        if self.merger and not _RARE.search(text):
            return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()
        out, plain, at = [], [], 0
        for end in [*(m.start() for m in _BETWEEN.finditer(text)), len(text)]:
            word, at = text[at:end], end
            if self.merger and not _RARE.search(word):
                plain.append(word)
                continue
            if plain:
                out.append(self._ids("".join(plain)))
                plain = []
            out.append(self.library[word])
        if plain:
            out.append(self._ids("".join(plain)))
        return b"".join(out)


@dataclass
class Plan:
    """Where the rests of each length go, by their numbers."""

    window: int
    counts: dict[int, int]
    sequences: int = 0
    #: length -> (first number, rests a sequence, first sequence, offset) of each interval, in order
    steps: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    #: length -> (first number, place of the first one) in the stream that is cut at ``edges``, whose sequences are from ``streamed`` on
    stream: dict[int, tuple[int, int]] = field(default_factory=dict)
    full: int = 0
    streamed: int = 0
    edges: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.left = Counter({k: n for k, n in self.counts.items() if k and n})
        self.taken = Counter()

    def use(self, pattern: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences that hold, in order, so many rests of each length: (length, rests)."""
        at = 0
        for length, rests in pattern:
            self.steps.setdefault(length, []).append((self.taken[length], rests, self.sequences, at))
            self.taken[length] += times * rests
            self.left[length] -= times * rests
            at += length * rests
        self.sequences += times

    def pack(self) -> None:
        """What is left: each length leads sequences filled by the longest that fit, as long as that fills them; then the stream."""
        have = sorted((k for k, n in self.left.items() if n), reverse=True)
        for lead in have:
            while self.left[lead]:
                gap, pattern = self.window, []
                for k in have[have.index(lead) :]:
                    rests = min(self.left[k], gap // k)
                    if rests:
                        pattern.append((k, rests))
                        gap -= k * rests
                if gap:
                    break
                self.use(pattern, min(self.left[k] // rests for k, rests in pattern))
        at = 0
        for k in have:
            if self.left[k]:
                self.stream[k] = (self.taken[k], at)
                at += k * self.left[k]
        self.streamed, self.full = self.sequences, at // self.window
        rest, edge = at % self.window, self.full * self.window
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.edges.append(edge)
                edge += 1 << bit
        self.sequences += self.full + len(self.edges)
        self.edges.append(edge)

    def pieces(self, length: int, number: int):
        """(tokens, sequence, offset) of each piece of a rest."""
        first, at = self.stream.get(length, (None, 0))
        if first is None or number < first:
            steps = self.steps[length]
            start, rests, sequence, offset = steps[bisect_right(steps, number, key=lambda s: s[0]) - 1]
            use, slot = divmod(number - start, rests)
            yield length, sequence + use, offset + slot * length
            return
        at += (number - first) * length
        to = at + length
        while at < to:
            if at < self.full * self.window:
                sequence, offset = divmod(at, self.window)
                end = at - offset + self.window
            else:
                sequence = bisect_right(self.edges, at) - 1
                offset, end = at - self.edges[sequence], self.edges[sequence + 1]
                sequence += self.full
            yield min(to, end) - at, self.streamed + sequence, offset
            at = min(to, end)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of two (a = 0) or three lengths that fill the window, a <= b <= c."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([(0, b, window - b) for b in lengths.tolist() if 2 * b <= window and have[window - b]], np.int64).reshape(-1, 3)]
    for a in lengths.tolist():
        b = lengths[(lengths >= a) & (a + 2 * lengths <= window)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(out)


def repeats(sets: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with least |A x - counts|, the columns of A being the sets of lengths.

    Coordinate descent: each round moves the sets whose step gains most among all that share a
    length with them; these share none, so that their steps are exact together.
    """
    x = np.zeros(len(sets))
    if not len(sets):
        return x
    residual = counts.astype(float)
    residual[0] = 0.0
    a, b, c = sets.T
    norm = 1.0 + (a > 0) + 1.0 + 2.0 * ((b == c).astype(float) + ((a == b) & (a > 0)) + ((a == c) & (a > 0)))
    order = np.arange(len(sets)) * 1e-12
    for _ in range(steps):
        slope = residual[a] + residual[b] + residual[c]
        step = np.maximum(-x, slope / norm)
        gain = step * slope - 0.5 * step * step * norm
        gain = np.where(np.abs(step) >= 0.5, gain * (1 - order), 0.0)
        best = np.zeros(len(counts))
        for k in (a, b, c):
            np.maximum.at(best, k, gain)
        best[0] = 0.0
        chosen = np.flatnonzero((gain > 0) & (gain >= np.maximum(np.maximum(best[a], best[b]), best[c])))
        if not len(chosen):
            break
        x[chosen] += step[chosen]
        for k in (a, b, c):
            np.subtract.at(residual, k[chosen], step[chosen])
        residual[0] = 0.0
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Where rests with these lengths go."""
    made = Plan(window, dict(counts))
    lengths = np.array(sorted(made.left), np.int64)
    sets = combinations(lengths, window)
    histogram = np.zeros(window + 1)
    histogram[lengths] = [made.left[k] for k in lengths.tolist()]
    x = np.rint(repeats(sets, histogram)).astype(np.int64)
    for i in np.lexsort((np.arange(len(x)), -x)):
        if x[i] <= 0:
            break
        used = Counter(k for k in sets[i].tolist() if k)
        times = min(int(x[i]), *(made.left[k] // n for k, n in used.items()))
        if times > 0:
            made.use(sorted(used.items(), reverse=True), times)
    made.pack()
    return made


def _tokenised(docs: DataFrame, path: str, window: int, ids: bool) -> DataFrame:
    """run, doc_id, n, r (rest), nth (of this rest in the run), chunk (full sequences before it in the run), crcs of its full sequences, and the rest's ids; ``data`` has all ids if asked for."""

    def encode(batches):
        encoder = held(("packing", path), lambda: Encoder(path))
        kind = "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"
        run, seen, chunks = TaskContext.get().partitionId(), Counter(), 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = (encoder.ids(text) if text else b"") + END
                n = len(data) // 4
                full, r = divmod(n, window)
                crcs = [zlib.crc32(data[i * 4 * window : (i + 1) * 4 * window]) for i in range(full)]
                rest = np.frombuffer(data, "<u4")[full * window :].astype(kind).tobytes()
                rows.append((n, r, seen[r], chunks, crcs, rest, data if ids else None))
                seen[r] += 1
                chunks += full
            columns = zip(*rows, strict=True) if rows else [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows), pa.int32()), batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["run", "doc_id", "n", "r", "nth", "chunk", "crcs", "rest", "data"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"run int, doc_id {kind}, n long, r int, nth long, chunk long, crcs array<long>, rest binary, data binary")


def pieces(docs: DataFrame, path: str, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``ids`` also its ids, as bytes."""
    small_batches(docs.sparkSession)
    parts = materialize(_tokenised(docs, path, window, ids), "tokens")
    counts = materialize(parts.groupBy("run", "r").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {window}")).alias("full")), "counts")
    known = plan({r.r: r.rows for r in counts.groupBy("r").agg(F.sum("rows").alias("rows")).collect()}, window)  # one row a length
    before = counts.select("run", "r", (F.sum("rows").over(Window.partitionBy("r").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    runs = counts.groupBy("run").agg(F.sum("full").alias("full"))  # one row a task
    runs = runs.select("run", (F.sum("full").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full") + known.sequences).alias("first"))
    placed = parts.join(before.join(runs, "run"), ["run", "r"])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def place(batches):
        for batch in batches:
            whose, rows = [], []
            for i, (n, r, number, chunk, crcs, rest, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 8)), strict=True)):
                for k, crc in enumerate(crcs):
                    whose.append(i)
                    rows.append((k * window, window, crc, n, chunk + k, 0, data and data[k * 4 * window : (k + 1) * 4 * window]))
                start = len(crcs) * window
                own = np.frombuffer(rest, f"<u{len(rest) // r}").astype("<u4").tobytes() if r else b""
                at = 0
                for take, sequence, offset in shared.value.pieces(r, number) if r else ():
                    piece = own[4 * at : 4 * (at + take)]
                    whose.append(i)
                    rows.append((start + at, take, zlib.crc32(piece), n, sequence, offset, piece if ids else None))
                    at += take
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            out = [batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:6])]
            yield pa.RecordBatch.from_arrays([*out, pa.array(columns[6], pa.binary())] if ids else out, names=[*names, "ids"] if ids else names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = dict(docs.dtypes)["doc_id"]
    made = placed.select("doc_id", "n", "r", (F.col("nth") + F.col("before")).alias("number"), (F.col("chunk") + F.col("first")).alias("chunk"), "crcs", "rest", "data")
    return made.mapInArrow(place, f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in names[1:]) + (", ids binary" if ids else ""))


def sequences(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """sequence_id, tokens, ids (little-endian 32-bit) of every sequence, ready to be padded and trained on."""
    made = pieces(docs, path, window, ids=True).groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # window pieces at most
    return made.select("sequence_id", "tokens", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def padding(lengths, window: int = WINDOW) -> int:
    """Padded places: to the window, except at a power of two."""
    return sum(window - n for n in lengths if n & (n - 1))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
