"""Toxicity: a linear-chain conditional random field over words, and document scores from it.

Labels are of documents, so the tokens' labels are made first: features of words (the whole
word, and its prefixes of 2 to 8 letters) that are far likelier in toxic documents form a
lexicon, and in a toxic document the words that have one are labelled toxic.  The field has
two states; its weights (features, transitions, start) maximise the penalised likelihood of
labelled segments, by gradients from forward-backward.

Words without a feature of the lexicon share one emission.  A run of them acts on the chain
through the power of one 2 x 2 matrix, so forward-backward costs a text's marked words and
not its length, and is exact.  The marginals of the marked words sum up to the expected
number of toxic words; with the largest of them and the text's length it goes through a
logistic regression, fitted on the training rows with their true class shares, to the score.

Training takes at most ``DOCS`` whole texts of each label in the order of a hash of the id, those of up to
``CLIP`` characters before longer ones, and about ``SEGMENTS`` segments of them; predictions read whole texts.
Offsets come from the marginals: words whose probability is at least one half.

Defined results: a null or empty text gets the score of a text without toxic words and no offsets; if the
training rows lack a label, the score is the share of toxic rows smoothed to 1/2 when
there are none; offsets count code points of the text as it is, whatever lower case does to its length;
null labels are left out; repeated labels and ids count as they come, within ``DOCS``; of texts that tie in hash the
smaller id and md5 come first; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.held import held
from threadloom.workspace import small_batches

DOCS, CLIP, FEATURES, SEGMENT, SEGMENTS = 1500, 8000, 2000, 48, 1500
WORD = re.compile(r"[^\W\d_]+")
#: A word's features can't be read off a memo larger than this; it starts afresh.
MEMO = 300_000


def features(word: str) -> list[str]:
    """The whole word and its prefixes."""
    return [f"{word}$", *(word[:k] for k in range(2, min(len(word), 8) + 1))]


def find_lexicon(toxic: list[str], clean: list[str], most: int = FEATURES) -> list[str]:
    """Features by the log odds of their words' share in toxic and clean texts, if sure and common enough."""

    def count(texts):
        words, docs = Counter(), Counter()
        for t in texts:
            own = Counter(w.lower() for w in WORD.findall(t))
            docs.update(own.keys())
            words.update({w: min(n, 5) for w, n in own.items()})  # no text counts a word over five times
        found, spread = Counter(), Counter()
        for w, n in words.items():
            for f in features(w):
                found[f] += n
                spread[f] += docs[w]
        return found, spread, sum(words.values())

    (a, spread, na), (b, _, nb) = count(toxic), count(clean)
    scored = []
    for f, n in a.items():
        if spread[f] < max(4, 0.004 * len(toxic)):
            continue
        odds = np.log((n + 0.5) / (na + 1)) - np.log((b[f] + 0.5) / (nb + 1))
        sure = odds / np.sqrt(1 / (n + 0.5) + 1 / (b[f] + 0.5))
        if odds > 1.2 and sure > 3.5:
            scored.append((-sure, f))
    return [f for _, f in sorted(scored)[:most]]


class Gains(dict):
    """Word -> the emission of a marked word, or 0 for words without a mark."""

    def __init__(self, field):
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        field, own = self.field, self.field.marks(word.lower())
        found = self[word] = float(np.exp(np.clip(field.weights[own].sum() + field.weights[-1], -30, 30))) if own else 0.0
        return found

    def __reduce__(self):
        return Gains, (self.field,)


class Field:
    """Two-state chain: weights of features for state 1, of transitions [from, to], and of the start."""

    GAP = 64

    def __init__(self, lexicon: list[str]):
        self.index = {f: i for i, f in enumerate(lexicon)}
        self.weights = np.zeros(len(lexicon) + 1)  # the last: of any word
        self.moves, self.start = np.zeros((2, 2)), 0.0

    def marks(self, word: str) -> list[int]:
        return [self.index[f] for f in features(word) if f in self.index]

    def train(self, toxic: list[str], clean: list[str], rounds: int = 100, penalty: float = 0.02) -> None:
        segments, tags = [], []
        for texts, label in ((toxic, 1), (clean, 0)):
            plain, full = [], []
            for t in texts:
                words = [self.marks(w.lower()) for w in WORD.findall(t)]
                for i in range(0, len(words), SEGMENT):
                    (full if any(words[i : i + SEGMENT]) else plain).append(words[i : i + SEGMENT])
            step = max(1, len(full) * 2 // SEGMENTS)
            chosen = full[::step] + plain[:: max(1, len(plain) * 4 // SEGMENTS)]
            segments += chosen
            tags += [[label if m else 0 for m in s] for s in chosen]
        if not segments:
            return
        n, length = len(segments), SEGMENT
        row = np.array([i * length + j for i, s in enumerate(segments) for j, m in enumerate(s) for _ in m], int)
        col = np.array([f for s in segments for m in s for f in m], int)
        here = np.zeros((n, length), bool)
        gold = np.zeros((n, length))
        for i, t in enumerate(tags):
            here[i, : len(t)] = True
            gold[i, : len(t)] = t
        pairs = here[:, 1:]
        g = gold.astype(int)
        seen = np.array([[((g[:, :-1] == a) & (g[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
        theta = np.zeros(len(self.weights) + 5)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k = len(self.weights)
        gold_f = np.bincount(col, gold.ravel()[row], k)
        gold_f[-1] = gold.sum()
        for t in range(1, rounds + 1):
            w, move, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[-1]
            emit = np.bincount(row, w[col], n * length).reshape(n, length) + w[-1]
            e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
            tr = np.exp(move)
            alpha, beta = np.zeros((n, length, 2)), np.ones((n, length, 2))
            alpha[:, 0] = e[:, 0] * [1, np.exp(start)]
            alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
            for j in range(1, length):
                x = (alpha[:, j - 1] @ tr) * e[:, j]
                alpha[:, j] = np.where(here[:, j, None], x / x.sum(1, keepdims=True), alpha[:, j - 1])
            for j in range(length - 2, -1, -1):
                x = (beta[:, j + 1] * e[:, j + 1]) @ tr.T
                beta[:, j] = np.where(here[:, j + 1, None], x / x.sum(1, keepdims=True), 1)
            p = alpha * beta
            p = (p / p.sum(2, keepdims=True))[:, :, 1] * here
            two = alpha[:, :-1, :, None] * tr * (e * beta)[:, 1:, None, :]
            two = (two / two.sum((2, 3), keepdims=True) * pairs[:, :, None, None]).sum((0, 1))
            have_f = np.bincount(col, p.ravel()[row], k)
            have_f[-1] = p.sum()
            grad = np.concatenate((gold_f - have_f, (seen - two).ravel(), [gold[:, 0].sum() - p[:, 0].sum()])) / n - penalty / n * theta * 20
            m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
            theta = theta + 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-9)
        self.weights, self.moves, self.start = theta[:k], theta[k : k + 4].reshape(2, 2), float(theta[-1])

    def ready(self) -> Field:
        """Tables for marginals: powers of the step over an unmarked word, each scaled."""
        step = np.exp(self.moves) * [1.0, np.exp(self.weights[-1])]
        self.powers, self.doubled = [np.eye(2)], [step / step.max()]
        for _ in range(self.GAP):
            x = self.powers[-1] @ step
            self.powers.append(x / x.max())
        for _ in range(40):
            x = self.doubled[-1] @ self.doubled[-1]
            self.doubled.append(x / x.max())
        self.begin = np.array([1.0, np.exp(self.start)])
        self.plain = np.array([1.0, np.exp(self.weights[-1])])
        self.cross = np.exp(self.moves)
        self.gains = Gains(self)
        return self

    def over(self, gap: int) -> np.ndarray:
        """The step over ``gap`` unmarked words, scaled: from the table, or by squaring."""
        if gap <= self.GAP:
            return self.powers[gap]
        x = np.eye(2)
        for k in range(gap.bit_length()):
            if gap >> k & 1:
                x = x @ self.doubled[k]
                x = x / x.max()
        return x

    def marginals(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, places of the marked ones, their probabilities of state 1."""
        words = WORD.findall(text)
        gains = np.fromiter(map(self.gains.__getitem__, words), float, len(words))
        at = np.flatnonzero(gains)
        if not len(at):
            return len(words), at, gains[:0]
        past, forward = -1, []
        a = None
        for i in at.tolist():
            gap = i - past - 1
            if a is None:  # from the start over the words before the first marked one
                a = self.begin if gap == 0 else (self.begin * self.plain) @ self.over(gap - 1) @ self.cross
            else:
                a = a @ self.over(gap) @ self.cross
            a = a * (1.0, gains[i])
            a = a / a.sum()
            forward.append(a)
            past = i
        out = np.empty(len(at))
        b = self.over(len(words) - 1 - int(at[-1])).sum(axis=1)
        for j in range(len(at) - 1, -1, -1):
            p = forward[j] * b
            out[j] = p[1] / p.sum()
            if j:
                b = self.over(int(at[j] - at[j - 1]) - 1) @ (self.cross @ (b * (1.0, gains[at[j]])))
                b = b / b.max()
        return len(words), at, out


def summary(words: int, p: np.ndarray) -> list[float]:
    total = float(p.sum())
    return [1.0, np.log(total + 0.02), float(p.max()) if len(p) else 0.0, np.log(words + 1.0), total / np.sqrt(words + 1.0), min(total, 20.0)]


class Scorer:
    def __init__(self, rows: list[tuple[str, int]], shares: tuple[float, float]):
        toxic, clean = [t for t, x in rows if x], [t for t, x in rows if not x]
        self.field = None
        self.default = shares[1] / sum(shares) if sum(shares) else 0.5
        if not toxic or not clean:
            return
        self.field = Field(find_lexicon(toxic, clean))
        self.field.train(toxic, clean)
        self.field.ready()
        x = np.array([summary(*(lambda r: (r[0], r[2]))(self.field.marginals(t))) for t in toxic + clean])
        y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
        weight = np.where(y == 1, shares[1] / len(toxic), shares[0] / len(clean))
        weight *= len(y) / weight.sum()
        self.mid, self.wide = x.mean(0), np.maximum(x.std(0), 1e-9)
        self.mid[0], self.wide[0] = 0, 1
        z = (x - self.mid) / self.wide
        beta = np.zeros(z.shape[1])
        ridge = np.diag([1e-3] + [0.3] * (z.shape[1] - 1))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ beta)
            beta += np.clip(step, -3, 3)
        self.beta = beta

    def score(self, text: str | None) -> float:
        if self.field is None:
            return self.default
        words, _, p = self.field.marginals(text or "")
        z = (np.array(summary(words, p)) - self.mid) / self.wide
        return float(1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30))))

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offending words: (start, end, probability), in code points."""
        if self.field is None or not text:
            return []
        _, at, p = self.field.marginals(text)
        if not (p >= least).any():
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [(*places[i], float(x)) for i, x in zip(at.tolist(), p.tolist(), strict=True) if x >= least]


def held_out_rows(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, docs_each: int = DOCS) -> Scorer:
    """A scorer from the labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_rows()).select("doc_id", "toxic")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    length = F.greatest(F.char_length("text"), F.lit(CLIP)).alias("length")
    sized = docs.where("text is not null and doc_id is not null").select("doc_id", length, F.xxhash64("doc_id").alias("h")).join(known, "doc_id")
    rows = []
    for toxic in sorted(counts):  # 0 and 1; each task keeps its least ``docs_each`` rows
        picked = sized.where(F.col("toxic") == toxic).orderBy("length", "h", "doc_id").limit(docs_each).distinct()
        texts = docs.where("text is not null").select("doc_id", length, "text", F.md5(F.col("text").cast("binary")).alias("g"))
        found = texts.join(F.broadcast(picked), ["doc_id", "length"]).orderBy("length", "h", "doc_id", "g").limit(docs_each)
        rows += [(r.text, toxic) for r in found.select("text").collect()]
    return Scorer(rows, (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending words' offsets of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # bounded by FEATURES

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        held(None)
        scorer, scores, spans = shared.value, [], []
        for t in texts:
            scores.append(scorer.score(t))
            spans.append([{"start": a, "end": b} for a, b, _ in scorer.spans(t)])
        return pd.DataFrame({"score": scores, "spans": spans})

    made = docs.select("doc_id", held_out_rows().alias("held_out"), judge(F.col("text").cast("string")).alias("made")).select("doc_id", "held_out", "made.*")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    made = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
    return made.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), places.alias("spans"))
