"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the encoding's last token is unique: it is the one vocabulary token
that ends there and that may follow the last token of the prefix before it, where two tokens may
follow one another if encoding their joined bytes gives the two back. One table row a byte thus
holds the whole encoding, bytes can be appended without touching earlier rows, and an edit needs
new rows only until they agree with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .session import ship
from .words import chunks, spans

#: Pieces and pairs of tokens that a worker keeps at most; more only costs making some anew.
CACHED, PAIRS = 2_000_000, 400_000
#: Fixed value: how the rank files' texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks by bytes, and what may follow what. Memos are emptied when full, which costs time only."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        #: The tokens read backwards, as a tree: (node, byte) to node, and the token that a node ends.
        self.back, self.ending = {}, [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                if (to := self.back.get(node << 8 | byte)) is None:
                    to = self.back[node << 8 | byte] = len(self.ending)
                    self.ending.append(-1)
                node = to
            self.ending[node] = rank
        self._follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._made: dict[int, tuple[bytes, bytes] | None] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}

    def merged(self, piece: bytes, stop: int = 1) -> list[int]:
        """Encoding by its definition: merge the adjacent pair of the lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.bytes[token]) == [token]
        return known

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a single byte."""
        if token not in self._made:
            piece = self.bytes[token]
            parts = self.merged(piece, stop=2)
            self._made[token] = (self.bytes[parts[0]], self.bytes[parts[1]]) if len(piece) > 1 else None
        return self._made[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of the token while it is merged: bytes, rank it is made at, rank it is taken at."""
        if (known := self._edges.get((token, side))) is None:
            known, taken, piece = [], 1 << 60, self.bytes[token]
            while True:
                made = self.ranks[piece]
                known.append((piece, made if len(piece) > 1 else -1, taken))
                if (halves := self._halves(made)) is None:
                    break
                piece, taken = halves[side], made
            self._edges[token, side] = known
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether no merge crosses the boundary of the two tokens.

        Ranks work as time. A crossing merge needs a part that stands at the end of the first and one
        at the start of the second at once, and must come before either is taken into a larger part; of
        equal ranks the leftmost comes first.
        """
        if (known := self._follows.get(before << 32 | token)) is None:
            if len(self._follows) > PAIRS:
                self._follows.clear()
            known, get = self.whole(token), self.ranks.get
            for left, left_made, left_taken in self._edge(before, 1):
                for right, right_made, right_taken in self._edge(token, 0):
                    if left_made < right_taken and right_made < left_taken and (r := get(left + right)) is not None and r < left_taken and r <= right_taken:
                        known = False
            self._follows[before << 32 | token] = known
        return known


class Prefixes:
    """The table of last tokens of one piece: ``last[i]`` ends the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        self.piece += more
        for end in range(len(self.last) + 1, len(self.piece) + 1):
            self.last.append(self._at(end))
        return self

    def _at(self, end: int) -> int:
        v, node, piece, last = self.vocabulary, 0, self.piece, self.last
        for start in range(end - 1, -1, -1):
            if (node := v.back.get(node << 8 | piece[start])) is None:
                break
            token = v.ending[node]
            if token >= 0 and (v.follows(last[start - 1], token) if start else v.whole(token)):
                return token  # no other can be valid here
        raise ValueError("the vocabulary has no token for some byte")

    def replace(self, start: int, end: int, new: bytes) -> Prefixes:
        """Put new in place of bytes start to end; rows are made anew only until they agree again."""
        old, moved = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, agreeing = old[:start], 0
        for at in range(start + 1, len(self.piece) + 1):
            self.last.append(self._at(at))
            behind = at - 1 - moved
            agreeing = agreeing + 1 if at > start + len(new) and old[behind] == self.last[-1] else 0
            if agreeing >= self.vocabulary.longest:
                self.last += old[behind + 1 :]
                break
        return self

    def become(self, piece: bytes) -> Prefixes:
        """Turn into another piece, whose common prefix with this one keeps its rows."""
        same, most = 0, min(len(piece), len(self.piece))
        while same < most and piece[same] == self.piece[same]:
            same += 1
        self.piece = piece[:same]
        del self.last[same:]
        return self.append(piece[same:])

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Pieces:
    """Bounds of the matches of the rank files' pattern, found for all characters at once.

    Characters are letters, numbers, white space or others. A run of one kind but white space is a
    piece, with a blank before it if there is one; white space before something loses its last
    character to a piece of its own or to the next; an apostrophe alone takes an English ending.
    """

    def __init__(self, pattern: str):
        if pattern != PATTERN:
            raise ValueError("these bounds are of one pattern")
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        kinds = np.full(0x110000, 3, np.uint8)
        for kind, members in enumerate((r"\p{L}", r"\p{N}", r"\p{White_Space}")):
            found = "".join(regex.findall(members + "+", every))
            kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        self.kinds = kinds

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte positions where pieces start; the texts' starts are among them."""
        chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        n, at = len(chars), np.flatnonzero((data & 0xC0) != 0x80)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kinds[chars]
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(at, bounds)] = True
        start = opens[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        word = np.flatnonzero(start & (kind != 2) & ~opens[:n])  # what comes before these is of their text
        after = word[kind[word - 1] == 2]
        start[after - 1] = True
        start[after[chars[after - 1] == 32]] = False
        quote = np.flatnonzero((chars == 39) & start[:n])
        quote = quote[quote + 1 < n]
        quote = quote[~opens[quote + 1] & (kind[quote + 1] == 0)]
        one = chars[quote + 1]
        two = np.where((quote + 2 < n) & ~opens[np.minimum(quote + 2, n)], chars[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[single | double] + 1] = False
        ends = np.concatenate([quote[single] + 2, quote[double] + 3])
        start[ends[ends < n]] = True
        return at[np.flatnonzero(start)]


class Encoder:
    """Encodes runs of texts: each distinct piece once, kept between runs in arrays sorted by hash.

    The ids of a run are decoded again. Where a piece does not come back, its hash is another's too,
    and the run is encoded by the pieces' bytes instead.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pieces = Vocabulary(ranks), Pieces(pattern)
        lengths = np.array([len(t) for t in self.vocabulary.bytes])
        self._lengths, self._from = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self._all = np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._keys, self._at, self._size, self._bytes, self._pool, self._used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1 << 16, "<u4"), 0

    def _tokens(self, pieces: list[bytes]) -> list[list[int]]:
        """Encode the pieces in the order of their bytes: what one shares with the one before it is done."""
        table, got = Prefixes(self.vocabulary), [[]] * len(pieces)
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            whole = self.vocabulary.ranks.get(pieces[i])  # as the library does, a piece that is a token stays one
            got[i] = [whole] if whole is not None else table.become(pieces[i]).tokens()
        return got

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        got = self._tokens(pieces)
        size = np.fromiter(map(len, got), np.int32, len(got))
        ids = np.fromiter((t for tokens in got for t in tokens), "<u4", int(size.sum()))
        if self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.zeros(self._used + 2 * len(ids), "<u4")])
        self._pool[self._used : self._used + len(ids)] = ids
        to = np.searchsorted(self._keys, keys)
        self._at = np.insert(self._at, to, self._used + np.cumsum(size) - size)
        self._keys, self._size = np.insert(self._keys, to, keys), np.insert(self._size, to, size)
        self._bytes = np.insert(self._bytes, to, np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self._used += len(ids)

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self._keys, keys), max(len(self._keys) - 1, 0))
        return at, self._keys[at] == keys if len(self._keys) else np.zeros(len(keys), bool)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        return self.both_ways(data, bounds)[:2]

    def both_ways(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As encode, then the bytes decoded from the ids and where each id's end."""
        start = self.pieces(data, bounds)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        keys, first, which = np.unique(spans(data, start, end), return_index=True, return_inverse=True)
        at, known = self._where(keys)
        if not known.all():
            raw = data.tobytes()
            if len(self._keys) + len(keys) > CACHED:
                self._forget()
                known[:] = False
            self._learn(keys[~known], [raw[a:b] for a, b in zip(start[first[~known]].tolist(), end[first[~known]].tolist(), strict=True)])
            at, _ = self._where(keys)
        ids, ends = gather(self._pool, self._at[at], self._size[at].astype(np.int64), which)
        back, back_ends = self.decode(ids)
        if not (np.array_equal(self._bytes[at][which], end - start) and np.array_equal(back, data)):
            ids, ends = self._by_bytes(data.tobytes(), start.tolist(), end.tolist())
            back, back_ends = self.decode(ids)
        return ids, np.append(0, ends)[np.searchsorted(start, bounds)], back, back_ends

    def _by_bytes(self, raw: bytes, start: list[int], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [raw[a:b] for a, b in zip(start, end, strict=True)]
        each = list(set(pieces))
        known = dict(zip(each, self._tokens(each), strict=True))
        ids = np.fromiter((t for p in pieces for t in known[p]), "<u4")
        return ids, np.cumsum([len(known[p]) for p in pieces])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids in a row, and where each id's end."""
        return gather(self._all, self._from[:-1], self._lengths, ids)


def gather(pool: np.ndarray, at: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered which of the pool one after another, and where each ends."""
    size = lengths[which]
    ends = np.cumsum(size)
    return pool[np.repeat(at[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}, pattern)


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text; one row per row of docs, in no order.

    Returns the key, the number of tokens, a digest of the ids and one of the decoded bytes, and the
    ids themselves (binary, little-endian unsigned 32-bit) if asked. Null and empty texts give no
    tokens; a null key stays null; repeated rows each give a row; other columns are ignored. Nothing
    is shuffled. The rank file is sent to the executors: its size is the vocabulary's, whatever the input.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                got, ends, back, back_ends = encoder.both_ways(data, bounds)
                back_ends = np.append(0, back_ends)[ends]
                cut = [got[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                digests = [hashlib.sha256(x).hexdigest() for x in cut]
                decoded = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(back_ends[:-1], back_ends[1:], strict=True)]
                columns = [batch.column(0).slice(at, to - at).cast(pa.int64()), pa.array(np.diff(ends)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(cut, pa.binary())] if ids else []), names + ["ids"] * ids)

    return docs.select(docs[key], docs[text]).mapInArrow(run, ENCODED + ", ids binary" * ids)
