"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens that no piece of the vocabulary reaches across. The distinct pre-tokens of a batch are
held as one flat array of symbols; every round merges the lowest-ranked pair of every sequence at once, until no
sequence has a pair that is a piece. What is left are the tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map

SPACE = "▁"
OVER = 4096
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 500_000
#: Rounds after which a sequence that still has pairs is merged one by one: long runs in which every merge outranks
#: the next, such as thousands of spaces.
ROUNDS = 256


_SLOT_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces and the pairs that make them, as sorted arrays."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.processor
        usual = [
            i for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        ]
        self.pieces = {p.id_to_piece(i): i for i in usual}
        self.size = p.get_piece_size()
        order = np.unique([-p.get_score(i) for i in usual])
        rank = {i: int(np.searchsorted(order, -p.get_score(i))) for i in usual}
        made = sorted(
            (self.pieces[piece[:k]] * self.size + self.pieces[piece[k:]], i)
            for piece, i in self.pieces.items() for k in range(1, len(piece))
            if piece[:k] in self.pieces and piece[k:] in self.pieces
        )
        self.keys = np.array([k for k, _ in made] or [-1], np.int64)
        self.whole = np.array([i for _, i in made] or [-1], np.int64)
        self.ranks = np.array([rank[i] for _, i in made] or [0], np.int64)
        self.none = len(order) + 1
        # a slot has the place of one pair; where several share it, the others are looked up in the sorted keys
        slot = (self.keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)
        self.slots = np.zeros(1 << _SLOT_BITS, np.int64)
        self.slots[slot] = np.arange(len(slot))
        self.shared = np.bincount(slot.astype(np.int64), minlength=1 << _SLOT_BITS) > 1
        self.letters = np.full(0x110000, -1, np.int64)
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        long = [piece for piece in self.pieces if len(piece) > 1]
        # pieces may begin with spaces but hold none after another character; line feeds may be in none
        spaced = all(SPACE not in piece.lstrip(SPACE) for piece in long)
        lined = not any("\n" in piece for piece in long)
        if not spaced:
            raise ValueError("a piece of this vocabulary reaches across a space")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lined else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that two symbols make; the rank is ``none`` where they make none."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        slot = (key.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)
        at = self.slots[slot]
        missed = np.flatnonzero(self.shared[slot] & (self.keys[at] != key))
        at[missed] = np.minimum(np.searchsorted(self.keys, key[missed]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.whole[at]

    def pretokens(self, text: str | None) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def symbols(self, tokens: list[str]) -> np.ndarray:
        """A number per character; those outside the vocabulary are numbered by their bytes, above all pieces."""
        codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.letters[codes]
        other = out < 0
        n_bytes = 1 + (codes[other] > 0x7F) + (codes[other] > 0x7FF) + (codes[other] > 0xFFFF)
        out[other] = self.size + n_bytes
        return out

    def counts(self, tokens: list[str]) -> np.ndarray:
        """How many tokens each pre-token has."""
        out = np.zeros(len(tokens), np.int64)
        sym = self.symbols(tokens)
        seq = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        rank, whole = self.pair(sym, np.append(sym[1:], self.size))
        rank[np.flatnonzero(seq[1:] != seq[:-1])] = self.none
        for _ in range(ROUNDS):
            if not len(sym):
                return out
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, start)
            lengths = np.diff(np.append(start, len(seq)))
            each = np.repeat(low, lengths)
            if (low == self.none).any():
                live = each < self.none
                out += np.bincount(seq[~live], np.where(sym > self.size, sym - self.size, 1)[~live], len(out)).astype(np.int64)
                sym, seq, rank, whole, each = (a[live] for a in (sym, seq, rank, whole, each))
            sym, seq, rank, whole = self._merge(sym, seq, rank, whole, each)
        for s in np.unique(seq):
            out[s] += sum(x - self.size if x > self.size else 1 for x in self._one_by_one(sym[seq == s].tolist()))
        return out

    def _merge(self, sym, seq, rank, whole, each):
        """One round: in each sequence the lowest-ranked pair, wherever it stands, unless a merge makes a pair that
        would have to come first; then only the leftmost. Only the pairs beside a merge are looked up again."""
        if not len(sym):
            return sym, seq, rank, whole
        at = np.flatnonzero(rank == each)
        # of overlapping pairs every second, from the left
        first = np.append(True, np.diff(at) > 1)
        run = np.cumsum(first) - 1
        at = at[(at - at[first][run]) % 2 == 0]
        # a merged symbol beside one that the same round merges later
        close = at[:-1][np.diff(at) == 2]
        close = close[seq[close] == seq[close + 2]]
        passing, _ = self.pair(whole[close], sym[close + 2])
        slow = seq[close[passing <= each[close]]]

        def apply(at):
            new, keep = sym.copy(), np.ones(len(sym), bool)
            new[at] = whole[at]
            keep[at + 1] = False
            new, owner, ranks, wholes = new[keep], seq[keep], rank[keep], whole[keep]
            place = at - np.arange(len(at))
            changed = np.concatenate([place, place[place > 0] - 1])
            right = np.minimum(changed + 1, len(new) - 1)
            ranks[changed], wholes[changed] = self.pair(new[changed], new[right])
            ends = changed[(right == changed) | (owner[right] != owner[changed])]
            ranks[ends] = self.none
            return new, owner, ranks, wholes, changed, each[keep]

        new, owner, ranks, wholes, changed, limit = apply(at)
        slow = np.concatenate([slow, owner[changed[ranks[changed] <= limit[changed]]]])
        if len(slow):
            later = np.append(False, seq[at[1:]] == seq[at[:-1]])
            new, owner, ranks, wholes, _, _ = apply(at[~(later & np.isin(seq[at], slow))])
        return new, owner, ranks, wholes

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """The same merges in order of rank and place, with a heap."""
        n = len(sym)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        memo: dict = {}

        def look(a: int, b: int):
            if (a, b) not in memo:
                rank, whole = self.pair(np.array([a]), np.array([b]))
                memo[a, b] = (int(rank[0]), int(whole[0]))
            return memo[a, b]

        heap: list = []

        def push(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                rank, whole = look(sym[i], sym[right[i]])
                if rank < self.none:
                    heapq.heappush(heap, (rank, i, sym[i], sym[right[i]], whole))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], right[i] = whole, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i])
            push(i)
        return [s for s, ok in zip(sym, alive) if ok]


#: Vocabularies of this worker by the hash of their files.
_LOADED: dict[str, Vocabulary] = {}


def token_counts(
    docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", over: int = OVER
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` per row, for the vocabulary file at ``model_path``.

    Tokens are those of the vocabulary's library without begin, end or other added tokens; the names of special
    pieces inside a text are ordinary text. Null and empty texts have no bytes and no tokens. Repeated rows are
    counted each. The file is read on the driver, about half a megabyte goes to the executors. Columns other than
    key and text are not read.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    mark = hashlib.md5(data).hexdigest()
    model = docs.sparkSession.sparkContext.broadcast(data)
    kind = dict(docs.dtypes)[key]
    known: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _LOADED.get(mark) or _LOADED.setdefault(mark, Vocabulary(model.value))
        rows = [vocabulary.pretokens(t) for t in batch.column(1).to_pylist()]
        met = set().union(*rows)
        if len(known) + len(met) > REMEMBERED:
            known.clear()
        new = list(met.difference(known))
        for start in range(0, len(new), 1 << 15):
            part = new[start : start + (1 << 15)]
            known.update(zip(part, vocabulary.counts(part).tolist()))
        total = [sum(map(known.__getitem__, row)) for row in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(total, pa.int64())], names=["key", "n_bytes", "n_tokens"]
        )

    rows = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = arrow_map(rows, run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
