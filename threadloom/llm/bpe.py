"""Byte-level BPE as a lazily determinised transducer, and a streaming UTF-8 decode.

The merges define a nondeterministic transducer over bytes: a path remembers the token it
emitted last and where it stands in the trie of tokens, and may emit the token that ends at
its node if the merges would leave a boundary between the two.  Every prefix of a text has
exactly one path that stands between two tokens, namely its encoding, so the last tokens of the
paths are those of the encoding up to the places where they began.  They are kept by place, as
registers, and a state of the deterministic transducer is the set of the live paths' nodes alone;
its output at a byte is the one of the tokens ending there that may follow the register of its
own beginning.  States and moves are made as bytes ask for them and thrown away when there are
too many, which changes no output.  A path dies within the length of the longest
token, so what all live paths share is certain after a bounded lookahead, and is emitted.

Whether the merges leave a boundary between two tokens is read off their merge trees: along
the boundary stand the right edge of the one and the left edge of the other, and they stay
apart unless two parts that exist at the same time make a token of lower rank than what
either becomes next (of equal rank, the leftmost pair goes first).

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 machine that
keeps at most three bytes back, so a stream can be decoded token by token.

Memory of a worker is bounded by ``MOST_STATES``, ``MOST_PAIRS`` and ``MOST_PIECES``, and by the longest
text; batches reach it by bytes, not by rows.

Defined results: a null text encodes as the empty one (no tokens, hashes of nothing); a very long text,
and a very long match of the pattern, are encoded whole; repeated rows and ids, and null ids, keep their
rows; an empty table gives an empty result; other columns than ``keep`` are left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.held import held
from threadloom.workspace import small_batches

#: Most states of a transducer, pairs of tokens and pieces remembered before they start afresh: some 69 MB a worker, with the vocabulary and its trie.
MOST_STATES, MOST_PAIRS, MOST_PIECES = 20_000, 300_000, 80_000
#: Bytes of one match after which what is certain is emitted.
HELD = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The definition: while two neighbours make a token, join the pair of lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        low, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if low == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.step: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.ends: dict[int, int] = {}  # node -> token
        n = 0
        for t, i in ranks.items():
            at = 0
            for b in t:
                key = at << 8 | b
                if (to := self.step.get(key)) is None:
                    n += 1
                    self.step[key] = to = n
                at = to
            self.ends[at] = i
        self.inner = {key >> 8 for key in self.step}
        self.trees: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}  # (token before + 1) << token_bits | token
        self.token_bits = (max(ranks.values(), default=0) + 1).bit_length()
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first: one path, between tokens."""
        first = array("i", [0]).tobytes()
        self.ids: dict[bytes, int] = {first: 0}
        self.paths: list[bytes] = [first]  # of each state: the trie nodes of its paths, the longest first
        self.moves: dict[int, tuple[int, tuple, int]] = {}
        self.tests: dict[tuple, tuple] = {}

    def edges(self, token: int) -> tuple | None:
        """(left edge, right edge) of the token's merge tree, each from the byte to the token; None if unreachable."""
        found = self.trees.get(token, 0)
        if found != 0:
            return found
        piece, never, own = self.token[token], 1 << 40, lambda p: self.token.get(self.ranks.get(p), p)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        left, right = [own(parts[0])], [own(parts[-1])]
        while len(parts) > 1:
            low, at = min((self.ranks.get(a + b, never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low == never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts[0]) != len(left[-1]):
                left.append(own(parts[0]))
            if len(parts[-1]) != len(right[-1]):
                right.append(own(parts[-1]))
        found = self.trees[token] = None if len(parts) > 1 else (tuple(left), tuple(right))
        return found

    def may_follow(self, last: int, new: int) -> bool:
        """Whether the merges of both tokens' bytes end in just these two."""
        after, ok = self.edges(new), True
        if after is None or last < 0:
            return self.remember(last, new, after is not None)
        a, b, i, j, never = self.edges(last)[1], after[0], 0, 0, 1 << 40
        while True:
            x_next = self.ranks[a[i + 1]] if i + 1 < len(a) else never
            y_next = self.ranks[b[j + 1]] if j + 1 < len(b) else never
            low = self.ranks.get(a[i] + b[j])
            if low is not None and low < x_next and low <= y_next:
                ok = False
                break
            if i + 1 == len(a) and j + 1 == len(b):
                break
            if x_next <= y_next:
                i += 1
            else:
                j += 1
        return self.remember(last, new, ok)

    def remember(self, last: int, new: int, ok: bool) -> bool:
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[last + 1 << self.token_bits | new] = ok
        return ok

    def move(self, state: int, byte: int) -> tuple[int, tuple, int]:
        """The next state, the tokens that end at this byte as (size, token), and the shortest of them; made at first use."""
        live, ends = [], []
        for node in memoryview(self.paths[state]).cast("i"):
            if (to := self.step.get(node << 8 | byte)) is None:
                continue
            if to in self.inner:  # else no longer token begins so: the path can only end here
                live.append(to)
            if (token := self.ends.get(to)) is not None:
                ends.append((self.size[token], token))
        live = array("i", [*live, 0]).tobytes()
        to = self.ids.get(live)
        if to is None:
            to = self.ids[live] = len(self.paths)
            self.paths.append(live)
        tests = tuple(ends[:-1])
        return self.moves.setdefault(state << 8 | byte, (to, self.tests.setdefault(tests, tests), ends[-1][1] if ends else -1))

    def run(self, piece: bytes, state: int, last: list[int]) -> int:
        """Put the last token of the encoding up to each byte to ``last``, and return the state."""
        moves, pairs, bits, put = self.moves, self.pairs, self.token_bits, last.append
        for b in piece:
            try:
                state, tests, token = moves[state << 8 | b]
            except KeyError:
                state, tests, token = self.move(state, b)
            for size, longer in tests:  # one of all fits, so the shortest needs no test
                before = last[-size]
                ok = pairs.get(before + 1 << bits | longer)
                if ok or ok is None and self.may_follow(before, longer):
                    token = longer
                    break
            put(token)
        return state

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern; a match that is a token stays one, as in the library."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        state, last = 0, [-1]  # the token before what is held, then those that end at its bytes
        for i in range(0, len(piece), HELD):
            if i:
                self.emit(state, last, out)
            if len(self.paths) > MOST_STATES:
                kept = self.paths[state]
                self.clear()
                state = self.ids.setdefault(kept, 1)
                if state:
                    self.paths.append(kept)
            state = self.run(piece[i : i + HELD], state, last)
        return out + self.back(last, len(last) - 1)

    def back(self, last: list[int], at: int) -> list[int]:
        """Tokens of the encoding up to place ``at``, read from its end."""
        rest, size = [], self.size
        while at > 0:
            token = last[at]
            rest.append(token)
            at -= size[token]
        return rest[::-1]

    def emit(self, state: int, last: list[int], out: list[int]) -> None:
        """Move the tokens that all live paths share from ``last`` to ``out``."""
        n, shared = len(last) - 1, None
        trie = self.depths()
        for node in memoryview(self.paths[state]).cast("i"):
            at, cuts = n - trie[node], set()
            while at > 0:
                cuts.add(at)
                at -= self.size[last[at]]
            shared = cuts if shared is None else shared & cuts
        upto = max(shared, default=0)
        out += self.back(last, upto)
        del last[:upto]

    def depths(self) -> dict[int, int]:
        if not hasattr(self, "_depth"):
            self._depth = {0: 0}
            for key, to in self.step.items():  # parents come before children
                self._depth[to] = self._depth[key >> 8] + 1
        return self._depth


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get text; an unfinished character waits for its rest.

    What can't be UTF-8 becomes U+FFFD, as in the standard incremental decoder.
    """

    #: First byte -> (number of bytes to come, range of the next one)
    LEADS = {
        **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
        **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F),
        **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F),
    }

    def __init__(self):
        self.waiting, self.valid = b"", True

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end begin a character that may yet be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                if lead not in self.LEADS:
                    return 0
                more, low, high = self.LEADS[lead]
                for b in data[len(data) - back + 1 :]:
                    if not low <= b <= high:
                        return 0
                    more, low, high = more - 1, 0x80, 0xBF
                return back if more > 0 else 0
        return 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.waiting + data
        keep = 0 if final else self._unfinished(data)
        self.waiting = data[len(data) - keep :] if keep else b""
        data = data[: len(data) - keep] if keep else data
        try:
            return data.decode()
        except UnicodeDecodeError:
            self.valid = False
            return data.decode(errors="replace")


class Codec:
    """Encode and decode whole texts; remembers pieces that it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern)
        self.fst = fst = Transducer(ranks)
        self.table = [fst.token.get(i, b"") for i in range(max(fst.token, default=-1) + 1)]

        class Met(dict):
            old: dict[str, bytes] = {}  # when half is full it becomes the old half; what is met again stays

            def __missing__(self, piece: str) -> bytes:
                ids = self.old.get(piece)
                if ids is None:
                    made = fst.encode(piece.encode())
                    ids = struct.pack(f"<{len(made)}I", *made)
                if len(self) >= MOST_PIECES // 2:
                    self.old = dict(self)
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.met = Met()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.met.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: bytes, block: int = 1 << 16):
        """Decoded bytes, block by block."""
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), block):
            yield b"".join(map(self.table.__getitem__, every[i : i + block].tolist()))


def tokens(spark, path: str, pattern: str):
    """An Arrow UDF: text -> (n_tokens, ids_sha256, decoded_sha256, valid_utf8)."""
    small_batches(spark)
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: its size is fixed by the file
    mark = hashlib.sha256(repr((sorted(ranks.items())[:50], len(ranks), path, pattern)).encode()).hexdigest()

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "valid_utf8": pa.bool_()}

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")
    def encode(texts: pa.Array) -> pa.Array:
        codec, out = held(mark, lambda: Codec(shared.value, pattern)), []
        for text in texts:
            ids = codec.encode(text.as_py() or "")
            decoded, machine = hashlib.sha256(), Utf8Machine()
            for part in codec.decode(ids):
                decoded.update(part)
                machine.feed(part)
            machine.feed(b"", final=True)
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), machine.valid))
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return encode


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_tokens, ids_sha256, decoded_sha256, valid_utf8 of every document's whole text."""
    made: Column = tokens(docs.sparkSession, path, pattern)(F.col("text").cast("string"))
    return docs.select(*keep, made.alias("made")).select(*keep, "made.*")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
