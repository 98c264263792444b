"""Encoding and decoding by a given vocabulary of characters, special tokens and ranked merges. Vocabularies aren't learnt here.

A text is cut at special tokens, the longest first; what lies between becomes characters, carriage returns left out, and
the pair of lowest rank is merged at all its places, again and again. Pairs wait by rank with their places, so that a
merge touches its places and their neighbours alone, whatever the length of the text.

Merges join a token that ends with some character and one that begins with some, so between two characters that no merge
has there nothing is ever merged across. There a text falls into pieces that are merged each by itself, and a task merges
a frequent piece once.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The special tokens, in order of their ids.
SPECIALS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|endoftext|>")
#: Pieces that a task keeps with their ids, and characters of the longest of them.
KNOWN, LONGEST = 100_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Ids of tokens, merges (left id, right id) -> new id by rank, and which tokens are special."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], int] = field(default_factory=dict)
    specials: tuple[str, ...] = SPECIALS
    kind: str = "protein"

    @classmethod
    def of(cls, letters: str, words: Sequence[str] = (), specials: tuple[str, ...] = SPECIALS, kind: str = "protein") -> Vocabulary:
        """Special tokens, letters, and merges that spell the given words from their beginnings, in order."""
        ids = {t: k for k, t in enumerate([*specials, *dict.fromkeys(letters)])}
        merges: dict[tuple[int, int], int] = {}
        for word in words:
            for k in range(2, len(word) + 1):
                pair = (ids[word[: k - 1]], ids[word[k - 1]])
                merges.setdefault(pair, ids.setdefault(word[:k], len(ids)))
        return cls(ids, merges, specials, kind)

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        payload = json.loads(text)
        payload = payload.get("tokenizer", payload)
        ids = {str(t): int(k) for t, k in payload["str_to_int"].items()}
        if {int(k): t for k, t in payload["int_to_str"].items()} != {k: t for t, k in ids.items()}:
            raise ValueError("the two directions of a vocabulary differ")
        merges: dict[tuple[int, int], int] = {}
        for merge in payload.get("bpe_merges", ()):
            if len(merge["pair"]) != 2:
                raise ValueError("a merge is of two tokens")
            merges[tuple(map(int, merge["pair"]))] = int(merge["new_id"])
        return cls(ids, merges, tuple(payload.get("special_tokens", SPECIALS)), str(payload.get("sequence_type", "protein")))

    def to_json(self) -> str:
        return json.dumps({
            "sequence_type": self.kind, "special_tokens": list(self.specials), "str_to_int": self.ids,
            "int_to_str": {str(k): t for t, k in self.ids.items()},
            "bpe_merges": [{"pair": list(p), "new_id": k} for p, k in self.merges.items()],
        }, ensure_ascii=False, indent=2) + "\n"


class Coder:
    def __init__(self, vocabulary: Vocabulary, allowed: set[str] | None = None) -> None:
        self.v = vocabulary
        self.allowed = set(vocabulary.specials) if allowed is None else allowed
        self.ranks = {pair: k for k, pair in enumerate(vocabulary.merges)}
        self.pairs = list(vocabulary.merges)
        longest_first = sorted(vocabulary.specials, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.tokens = {k: t for t, k in vocabulary.ids.items()}
        self.letters = {t for t in vocabulary.ids if len(t) == 1}
        self.known: dict[str, bytes] = {}
        # Pieces end with a character that ends no left token, a space or mark where there are such, so that they are words;
        # None if there is no merge at all.
        first, last = self._ends(0), self._ends(1)
        #: Neighbours that a merge may bring together.
        self.linked = {(x, y) for a, b in vocabulary.merges for x in last[a] for y in first[b]}
        open_ended = {x for x, _ in self.linked}
        marks = {x for x in self.letters - open_ended if not x.isalnum()}
        inner = "".join(map(re.escape, sorted(self.letters - marks if marks else open_ended))) if self.linked else ""
        self.piece = re.compile(f"(?s)[{inner}]*[^{inner}]|[{inner}]+") if inner else None

    def _ends(self, side: int) -> dict[int, set[str]]:
        """The characters by which each token may begin, or end."""
        found: dict[int, set[str]] = defaultdict(set)
        for x in self.letters:
            found[self.v.ids[x]].add(x)
        more = True
        while more:
            more = False
            for pair, k in self.v.merges.items():
                if not found[pair[side]] <= found[k]:
                    found[k] |= found[pair[side]]
                    more = True
        return found

    def runs(self, text: str) -> Iterator[str]:
        """Special tokens and the texts between them."""
        for n, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if n % 2 and part not in self.allowed:
                raise ValueError(f"the special token {part} isn't allowed here")
            if part := part if n % 2 else part.replace("\r", ""):
                yield part

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers of the machine."""
        found = [array("i", [self.v.ids[run]]).tobytes() if run in self.allowed else self.coded(run) for run in self.runs(text)]
        return b"".join(found)

    def coded(self, run: str) -> bytes:
        if lacking := set(run) - self.letters:
            raise ValueError(f"characters that the vocabulary lacks: {sorted(lacking)}")
        if self.piece is None:
            return array("i", map(self.v.ids.__getitem__, run)).tobytes()
        known, found = self.known, []
        for piece in self.piece.findall(run):
            if (ids := known.get(piece)) is None:
                ids = self.noted(piece, b"".join(map(self.part, self.parts(piece))))
            found.append(ids)
        return b"".join(found)

    def parts(self, piece: str) -> Iterator[str]:
        """What lies between neighbours that no merge brings together."""
        start = 0
        for at, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair not in self.linked:
                yield piece[start:at]
                start = at
        yield piece[start:]

    def part(self, part: str) -> bytes:
        if (ids := self.known.get(part)) is None:
            ids = self.noted(part, array("i", self.merged(part)).tobytes())
        return ids

    def noted(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def merged(self, run: str) -> list[int]:
        """The ids of characters that the vocabulary has, merged as one text."""
        ids = [self.v.ids[x] for x in run]
        n = len(ids)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        places: dict[int, list[int]] = defaultdict(list)
        waiting: list[int] = []

        def note(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := self.ranks.get((ids[i], ids[after[i]]))) is not None:
                if rank not in places:
                    heapq.heappush(waiting, rank)
                places[rank].append(i)

        for i in range(n - 1):
            note(i)
        turn = 0
        while waiting:
            turn += 1
            rank = heapq.heappop(waiting)
            pair, changed = self.pairs[rank], []
            for i in sorted(set(places.pop(rank))):
                j = after[i]
                if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                    continue
                if made[i] == turn or made[j] == turn:  # a token of this turn waits for the next one
                    changed.append(i)
                    continue
                ids[i], ids[j], made[i], after[i] = self.v.merges[pair], None, turn, after[j]
                if after[i] < n:
                    before[after[i]] = i
                changed += [before[i], i]
            for i in changed:
                if i >= 0 and ids[i] is not None:
                    note(i)
        return [k for k in ids if k is not None]

    def decode(self, ids: Sequence[int], skip_special: bool = False) -> str:
        for k in ids:
            if k not in self.tokens:
                raise ValueError(f"the vocabulary has no token {k}")
        found = [self.tokens[k] for k in ids]
        return "".join(t for t in found if not (skip_special and t in self.v.specials))


def encoded(text: Column, vocabulary: Vocabulary, allowed: set[str] | None = None, bos: bool = False, eos: bool = False) -> Column:
    """The ids of a text, in Arrow batches; a null text has none but the ends that are asked for.

    A character that the vocabulary lacks and a special token that isn't among ``allowed`` fail the job.
    """
    head = array("i", [vocabulary.ids["<|bos|>"]] if bos else []).tobytes()
    tail = array("i", [vocabulary.ids["<|eos|>"]] if eos else []).tobytes()
    coder: list[Coder] = []

    def run(texts: pa.Array) -> pa.Array:
        if not coder:
            coder.append(Coder(vocabulary, allowed))
        found = [head + coder[0].encode_bytes(t.as_py() or "") + tail for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        if ends[-1] >= 2**31:
            raise ValueError("a batch has more ids than an Arrow list holds; take fewer rows a batch")
        values = pa.array(np.frombuffer(b"".join(found), np.int32))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    # Marked so that a plan which uses the ids twice doesn't encode twice.
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def decoded(ids: Column, vocabulary: Vocabulary, skip_special: bool = False) -> Column:
    """The text of ids; an id that the vocabulary lacks fails the job."""
    tokens = {k: "" if skip_special and t in vocabulary.specials else t for t, k in vocabulary.ids.items()}
    keys = np.array(sorted(tokens), np.int64)
    texts = [tokens[k] for k in keys.tolist()]

    def run(rows: pa.Array) -> pa.Array:
        values = rows.flatten()
        if values.null_count:
            raise ValueError("the vocabulary has no token None")
        found = values.to_numpy(zero_copy_only=False)
        if not len(found):
            return pa.array([""] * len(rows), pa.string())
        at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
        wrong = keys[at] != found if len(keys) else np.ones(len(found), bool)
        if wrong.any():
            raise ValueError(f"the vocabulary has no token {found[wrong][0]}")
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(texts, pa.string()).take(pa.array(at))), "")

    return F.arrow_udf(run, "string")(ids)
