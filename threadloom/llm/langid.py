"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text; it
accepts exactly the substrings of that sample.  A text is parsed greedily into phrases, each
the longest match with the sample from where the last one ended.  Phrases times the log of
the sample's length, per symbol, estimate the cross entropy; the lowest wins.

Symbols are lower-case letters.  If the samples have more than ``LETTERS`` different ones, the
rarer become the bytes of their UTF-8 form, so that no two letters are merged.

The automata are laid out as dense tables of (state, symbol class) -> next state, with a mark
where a phrase ends, so that many texts are parsed a step at a time.  Long texts are cut in
blocks of ``BLOCK`` symbols which are all parsed from the start of a phrase at first; then all at once
are parsed again from the state that the block before ended in, up to where both parses meet; those whose
start has changed by that are mended from left to right, each once, so the time is linear also in texts that
repeat the sample.  The result is the parse of the whole text.

Training takes at most ``DOCS`` whole texts a language in the order of a hash of the id, those of up
to ``CLIP`` characters before longer ones, until ``SYMBOLS`` symbols are reached (fewer with many
languages, so that the tables stay within ``TABLE_BYTES``).  Only where the first text alone is longer
than that, passages spread evenly over it are the sample.  Prediction reads whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no
labelled rows at all everything is ``und``; ties go to the language first by name; the score
is the runner-up's entropy over the sum of both (1 if only one language is known); repeated
rows and ids, and null ids, keep their rows; an empty table gives an empty result; other columns
are ignored (``keep_identified`` carries them along, whatever their names).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.held import held
from threadloom.workspace import fresh, small_batches

DOCS, CLIP, SYMBOLS, LETTERS, TABLE_BYTES, BLOCK, LANES = 300, 2000, 40_000, 120, 96 << 20, 256, 1 << 12
MISS = np.uint32(1 << 31)


def suffix_automaton(symbols: list[int], classes: int) -> np.ndarray:
    """Transitions [states, classes] of the automaton of all substrings; -1 where none."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(moves), classes), -1, np.int64)
    for s, m in enumerate(moves):
        table[s, list(m)] = list(m.values())
    return table


def passages(text: np.ndarray, symbols: int, parts: int = 16) -> np.ndarray:
    """At most ``symbols`` of ``text``: all of it, or passages spread evenly over it, a mark of no letter between them."""
    if len(text) <= symbols:
        return text
    each = max(1, symbols // parts - 1)
    starts = np.linspace(0, len(text) - each, parts).astype(int)
    return np.concatenate([np.append(text[i : i + each], np.uint8(0)) for i in starts.tolist()])[:symbols]


class CrossParser:
    """``samples``: language -> texts.  Symbol classes: 0 no letter, 1 a letter or byte unknown here, then letters, then bytes."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = SYMBOLS):
        self.languages = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        letters = sorted(sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS])
        rare = sorted({b for c in seen.keys() - set(letters) for b in c.encode("utf-8", "surrogatepass")})
        self.classes = len(letters) + len(rare) + 3  # the last pads a block and changes nothing
        self.of = np.zeros(0x110000, np.uint8)
        self.of[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        self.of[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))
        self.of_byte = np.ones(256, np.uint8)
        self.of_byte[rare] = np.arange(2 + len(letters), 2 + len(letters) + len(rare))
        self.spelled = bool(rare)
        if self.languages:
            symbols = max(64, min(symbols, TABLE_BYTES // (len(self.languages) * 2 * self.classes * 4)))
        tables, self.start, self.log = [], [], []
        base = 0
        for x in self.languages:
            chosen, size = [], 0
            for s in map(self.symbols, samples[x]):
                if not chosen or size + len(s) < symbols:
                    chosen += [s, np.zeros(1, np.uint8)]
                    size += len(s) + 1
            text = passages(np.concatenate(chosen), symbols)
            text = text[(text != 0) | np.append(True, text[:-1] != 0)].tolist()
            table = suffix_automaton(text, self.classes)
            root = np.maximum(table[0], 0)
            ends = table < 0
            to = (np.where(ends, root, table) + base).astype(np.uint32) * np.uint32(self.classes)
            to |= np.where(ends, MISS, np.uint32(0))
            to[:, -1] = (np.arange(len(table)) + base).astype(np.uint32) * np.uint32(self.classes)
            tables.append(to.ravel())
            self.start.append(base * self.classes)
            self.log.append(np.log2(max(len(text), 2)))
            base += len(table)
        self.table = np.concatenate(tables) if tables else np.empty(0, np.uint32)

    def symbols(self, text: str) -> np.ndarray:
        """Classes of the lower-cased characters; of a run without letters one symbol stays."""
        low = text.lower()
        c = self.of[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if self.spelled and (c == 1).any():
            raw = [low[i].encode("utf-8", "surrogatepass") for i in np.flatnonzero(c == 1).tolist()]
            times = np.ones(len(c), np.int64)
            times[c == 1] = [len(x) for x in raw]
            spelled = np.repeat(c == 1, times)
            c = np.repeat(c, times)
            c[spelled] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        return c[(c != 0) | np.append(True, c[:-1] != 0)] if len(c) else c

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases [text, language] of these symbol arrays."""
        cuts = [max(1, -(-len(t) // BLOCK)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), cuts)
        grid = np.full((len(owner), BLOCK), self.classes - 1, np.uint8)
        at = 0
        for t, n in zip(texts, cuts, strict=True):
            grid[at : at + n].ravel()[: len(t)] = t
            at += n
        steps, lanes, k = np.ascontiguousarray(grid.T), len(owner), len(self.languages)
        state = np.repeat(np.array(self.start, np.uint32)[:, None], lanes, 1)
        count = np.zeros(state.shape, np.uint16)
        follows = np.append(False, owner[1:] == owner[:-1])
        long = bool(follows.any())
        states, counts = (np.empty((BLOCK, k, lanes), t) if long else None for t in (np.uint32, np.uint16))
        for t, row in enumerate(steps):
            state += row
            state = self.table.take(state)
            count += (state >> np.uint32(31)).astype(np.uint16)
            state &= ~MISS
            if long:
                states[t], counts[t] = state, count
        total = count.astype(np.int64)
        if long:
            self._join(steps, np.flatnonzero(follows), state, total, states, counts)
        out = np.zeros((len(texts), k), np.int64)
        for i in range(k):
            out[:, i] = np.bincount(owner, total[i], len(texts)).astype(np.int64) + 1
        return out

    def _join(self, steps, follow, ends, total, states, counts) -> None:
        """Correct ``total`` and ``ends`` of the lanes that follow another: parse on from its end."""
        k = len(ends)
        begun = np.repeat(np.array(self.start, np.uint32)[:, None], ends.shape[1], 1)  # the state each parse began with
        which, lane = np.repeat(np.arange(k), len(follow)), np.tile(follow, k)
        new = ends[which, lane - 1] != begun[which, lane]
        which, lane = which[new], lane[new]
        begun[which, lane] = ends[which, lane - 1]
        w, x, state, more = which, lane, begun[which, lane], np.zeros(len(lane), np.int64)
        for t in range(BLOCK if len(lane) else 0):
            state = self.table.take(state + steps[t, x])
            more += state >> np.uint32(31)
            state &= ~MISS
            met = state == states[t, w, x]
            if met.any():
                total[w[met], x[met]] = more[met] + counts[-1, w[met], x[met]] - counts[t, w[met], x[met]]
                ends[w[met], x[met]] = states[-1, w[met], x[met]]
                w, x, state, more = w[~met], x[~met], state[~met], more[~met]
                if not len(x):
                    break
        total[w, x], ends[w, x] = more, state
        # most parses have met the one that began at the root; the others are mended from left to right, each lane once
        table, follows, miss = memoryview(self.table), set(follow.tolist()), int(MISS)
        for w in range(k):
            due = follow[ends[w, follow - 1] != begun[w, follow]].tolist()[::-1]
            while due:
                x = due.pop()
                s = int(ends[w, x - 1])
                if s == begun[w, x]:
                    continue
                begun[w, x], found = s, 0
                for t, (c, known) in enumerate(zip(steps[:, x].tolist(), states[:, w, x].tolist(), strict=True)):
                    s = table[s + c]
                    if s >= miss:
                        s -= miss
                        found += 1
                    if s == known:
                        found += int(counts[-1, w, x]) - int(counts[t, w, x])
                        s = int(states[-1, w, x])
                        break
                total[w, x] = found
                if s != ends[w, x]:
                    ends[w, x] = s
                    if x + 1 in follows and not (due and due[-1] == x + 1):
                        due.append(x + 1)

    def predict(self, texts) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = []
        block: list[np.ndarray] = []
        lanes = 0

        def flush():
            nonlocal block, lanes
            if not block:
                return
            size = np.array([max(len(s), 1) for s in block])
            rate = self.phrases(block) * np.array(self.log) / size[:, None]
            best = rate.argmin(axis=1)
            low = rate.min(axis=1)
            rate[np.arange(len(block)), best] = np.inf
            high = rate.min(axis=1)
            for s, k, a, b in zip(block, best, low, high, strict=True):
                if not (s > 0).any():
                    found.append(("und", 0.0))
                else:
                    found.append((self.languages[k], float(b / (a + b)) if np.isfinite(b) else 1.0))
            block, lanes = [], 0

        for text in texts:
            if not self.languages:
                found.append(("und", 0.0))
                continue
            s = self.symbols(text or "")
            block.append(s)
            lanes += max(1, -(-len(s) // BLOCK))
            if lanes >= LANES:
                flush()
        flush()
        return found


def training_rows(docs: DataFrame, held_out, docs_each: int = DOCS) -> dict[str, list[str]]:
    """Language -> texts of the sample, in its order; ids are picked before any text is fetched."""
    length = F.greatest(F.char_length("text"), F.lit(CLIP)).alias("length")
    first = Window.partitionBy("lang").orderBy("length", "h", "doc_id")
    fit = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out & F.col("text").rlike(r"\p{L}"))
    ids = fit.select("lang", "doc_id", length, F.xxhash64("doc_id").alias("h")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= docs_each)
    ids = ids.select("doc_id", F.col("lang").alias("of"), "length", "h").distinct()
    rows = fit.join(F.broadcast(ids), "doc_id").where((F.col("lang") == F.col("of")) & (length == F.col("length")))
    rows = rows.select("lang", "doc_id", "length", "h", "text", F.md5(F.col("text").cast("binary")).alias("g"))
    # a repeated id may have brought more rows
    ordered = Window.partitionBy("lang").orderBy("length", "h", "doc_id", "g")
    rows = rows.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= docs_each).select("lang", "rank", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        if any(c.isalpha() for c in r.text):
            out.setdefault(r.lang, []).append(r.text)
    return out


def held_out_rows(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictor(docs: DataFrame):
    """An Arrow UDF: text -> (lang_pred, score), learned from the labelled rows of ``docs``."""
    small_batches(docs.sparkSession)
    parser = CrossParser(training_rows(docs, held_out_rows()))
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # at most TABLE_BYTES, and 1 MB of classes

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        held(None)
        found = shared.value.predict(texts.to_pylist())
        languages, scores = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    made = predictor(docs)(F.col("text").cast("string")).alias("made")
    return docs.select("doc_id", held_out_rows().alias("held_out"), made).select("doc_id", "held_out", "made.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in some language: all but those that are ``und``, with all their columns."""
    made = fresh(docs, "lang_pred")
    return docs.withColumn(made, predictor(docs)(F.col("text").cast("string"))["lang_pred"]).where(F.col(made) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
