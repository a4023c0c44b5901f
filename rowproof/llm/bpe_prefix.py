"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of the
prefix's encoding.  ``last_tokens`` stores that token for each prefix: token
``t`` ends the encoding of ``piece[:i]`` if the encoding of the bytes before it
ends with a token that may stand directly before ``t``, that is, if the two
tokens' bytes encode to just these two.  The encoding is read off backwards.
Because a prefix's entry depends on earlier entries only, bytes can be
appended exactly (``Piece.append``), and an edit re-encodes only from the edited
place to where the entries agree with the old ones again (``Piece.replace``).

Texts are split as the rank file's pattern asks, and each match is encoded on
its own.  Words repeat, so a worker keeps the encodings of space-led chunks in
a bounded memory; a chunk is a part of a text whose split cannot depend on its
surroundings.

Defined results: null and empty texts have no tokens (digests of the empty
string); repeated rows repeat; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Entries of a worker's memories of chunks and of token pairs.
CHUNKS = 500_000
PAIRS = 1_000_000
#: White space as the split pattern means it (the Unicode property).
SPACE = "\t-\r \x85\xa0  -     　"
#: A space with white space or an end of the text on its left, or white space on its right.
UNEVEN = re.compile(f"[{SPACE}] | [{SPACE}]")
#: Where a text may be cut: before a lone space between two visible characters.
CUT = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")


def chunks(text: str) -> tuple[str, list[str]]:
    """Parts of ``text`` that split alike wherever they stand: the first, and
    the others, each without the space that leads it."""
    if UNEVEN.search(text):
        first, *rest = CUT.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


class Vocabulary:
    """Ranks, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {b[:i] for b in ranks for i in range(len(b) + 1)}
        self.states: dict[bytes, State] = {}
        self.pattern = regex.compile(pattern)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.after: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.led: dict[str, tuple[int, str, bytes]] = {}
        self.parts = lru_cache(200_000)(self._parts)

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain rank-order merging, for the short byte strings of one or two tokens."""
        at = [piece[i : i + 1] for i in range(len(piece))]
        while len(at) > 1:
            rank, i = min((self.ranks.get(at[i] + at[i + 1], 1 << 60), i) for i in range(len(at) - 1))
            if rank == 1 << 60:
                break
            at[i : i + 2] = [at[i] + at[i + 1]]
        return at

    def _parts(self, token: int) -> tuple[bool, tuple[tuple[int, bytes], ...], tuple[tuple[int, bytes], ...]]:
        """Whether a token's bytes encode to itself, and what its left and right
        edges looked like while it was merged: (rank at which the edge part was
        merged away, edge part), as they change."""
        at = [self.bytes[token][i : i + 1] for i in range(len(self.bytes[token]))]
        left, right = [], []
        while len(at) > 1:
            rank, i = min((self.ranks.get(at[i] + at[i + 1], 1 << 60), i) for i in range(len(at) - 1))
            if rank == 1 << 60:
                return False, (), ()
            if i == 0:
                left.append((rank, at[0]))
            if i == len(at) - 2:
                right.append((rank, at[-1]))
            at[i : i + 2] = [at[i] + at[i + 1]]
        whole = (1 << 60, self.bytes[token])
        return True, (*left, whole), (*right, whole)

    def state(self, suffix: bytes) -> State:
        """The state of having just read ``suffix``: its longest end that begins a token."""
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        found = self.states.get(suffix)
        if found is None:
            ends = [(n, self.ranks[suffix[-n:]]) for n in range(len(suffix), 0, -1) if suffix[-n:] in self.ranks]
            found = self.states[suffix] = State(suffix, tuple((n, t, self.after.setdefault(t, {-1: True})) for n, t in ends if self.parts(t)[0]))
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` encode to exactly ``a, b``: no merge
        across the border has a better claim than those within the two."""
        known = self.after.setdefault(b, {-1: True})
        if a not in known:
            self.pairs += 1
            if self.pairs > PAIRS:
                self.pairs = 0
                for x in self.after.values():
                    x.clear()
                    x[-1] = True
            known[a] = self._may_follow(a, b)
        return known[a]

    def _may_follow(self, a: int, b: int) -> bool:
        ok_a, _, right = self.parts(a)
        ok_b, left, _ = self.parts(b)
        if not (ok_a and ok_b):
            return False
        i = j = 0
        while True:
            # The border parts right now, and the ranks at which each is merged away inside its own token.
            end_a, part_a = right[i]
            end_b, part_b = left[j]
            across = self.ranks.get(part_a + part_b, 1 << 60)
            # Of equal ranks the leftmost merge comes first: inside a before the border, the border before inside b.
            if across < end_a and across <= end_b and across != 1 << 60:
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if end_a <= end_b:
                i += 1
            else:
                j += 1

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in (self.parts_of(text) if text else ()) for i in part[1].split()]

    def parts_of(self, text: str) -> list[tuple[int, str, bytes]]:
        """Token count, ids as text with a space before each, and decoded bytes of
        each chunk of a text."""
        first, rest = chunks(text)
        found = list(map(self.led.get, rest))
        if None in found:
            if len(self.led) >= CHUNKS:
                self.led.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = self.chunk(" " + rest[i])
                    if len(rest[i]) <= 64:
                        self.led[rest[i]] = x
        return [self.chunk(first), *found] if first else found

    def chunk(self, text: str) -> tuple[int, str, bytes]:
        if text[0] == " " and text[1:].isalpha():
            return self.encoded(text)
        pieces = self.pattern.findall(text)
        if len(pieces) == 1:
            return self.piece(text)
        n, ids, back = zip(*map(self.piece, pieces), strict=True)
        return sum(n), "".join(ids), b"".join(back)

    def piece(self, text: str) -> tuple[int, str, bytes]:
        found = self.led.get(text[1:]) if text[0] == " " else self.known.get(text)
        if found is None:
            found = self.encoded(text)
            if text[0] != " " and len(text) <= 64:
                if len(self.known) >= CHUNKS // 2:
                    self.known.clear()
                self.known[text] = found
        return found

    def encoded(self, text: str) -> tuple[int, str, bytes]:
        ids = Piece(self, text.encode()).tokens()
        return len(ids), " " + " ".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])


class State:
    """Where a reader of bytes stands: the tokens that end here, longest first
    (length, token, and whether it may follow a token; -1 stands for no token)."""

    __slots__ = ("ends", "next", "suffix")

    def __init__(self, suffix: bytes, ends: tuple[tuple[int, int, dict[int, bool]], ...]):
        self.suffix, self.ends, self.next = suffix, ends, {}


class Piece:
    """One match of the pattern: its bytes and the last token of each prefix."""

    __slots__ = ("data", "last", "state", "v")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.state = vocabulary, b"", [-1], vocabulary.state(b"")
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        last, v, state = self.last, self.v, self.state
        i = len(last) - 1
        for c in data:
            i += 1
            to = state.next.get(c)
            if to is None:
                to = state.next[c] = v.state(state.suffix + bytes((c,)))
            state = to
            for n, t, known in state.ends:
                fits = known.get(last[i - n])
                if fits or fits is None and v.may_follow(last[i - n], t):
                    break
            last.append(t)
        self.state = state

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` for bytes ``start`` to ``end``; entries before ``start`` stay.

        An entry depends on the bytes of the longest token before it and on as many
        entries.  Behind the edit bytes are encoded again until that many entries
        in a row are the old ones; those that follow are the old ones, too."""
        tail, old, longest = self.data[end:], self.last[end + 1 :], self.v.longest
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.state = self.v.state(self.data[-longest:])
        self.append(data)
        for k in range(0, len(tail), longest):
            part = tail[k : k + longest]
            self.append(part)
            upto = k + len(part)
            if len(part) == longest and self.last[-longest:] == old[k:upto]:
                self.data += tail[upto:]
                self.last += old[upto:]
                self.state = self.v.state(self.data[-longest:])
                break

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t = self.last[i]
            out.append(t)
            i -= self.v.size[t]
        return out[::-1]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ranks, pattern)


def encode_digest(text: str | None, v: Vocabulary) -> tuple[int, str, str]:
    """Token count, SHA-256 of the ids, and SHA-256 of the bytes decoded from them."""
    ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
    parts = v.parts_of(text) if text else []
    for i in range(0, len(parts), 50_000):
        counts, said, data = zip(*parts[i : i + 50_000], strict=True)
        n += sum(counts)
        ids.update("".join(said)[0 if i else 1 :].encode())
        back.update(b"".join(data))
    return n, ids.hexdigest(), back.hexdigest()


def encoded_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            ids = [v.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            rows = [encode_digest(t, v) for t in b.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
