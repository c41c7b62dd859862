"""Byte-level BPE: each piece is merged by segment trees over its byte positions.

A tree's leaf is a byte position; it stores the rank of the pair that the token there makes with
its right neighbour, and each inner node the least rank below it. The leftmost least leaf is found
from the root. A merge writes three leaves, those of the live neighbours and of the token that
went, and the nodes above them. Pieces of similar length are merged together, one merge each at a
time, with the trees as rows of one array.
"""

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placeweave.llm.rows import with_computed
from placeweave.llm.tokens import RememberingEncoder

# The characters with the White_Space property of Unicode.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_PAIR = np.int32(2**31 - 1)
# Trees merged together have so many leaves at most in all; larger trees are merged alone.
LEAVES, LONG = 1 << 18, 1 << 9


def piece_pattern() -> regex.Pattern:
    """The public pattern, with white space named so that every library agrees on it."""
    named = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{WHITE}")
    return regex.compile(named.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Ranks:
    """Tokens by rank, and the rank that each pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.rank_of = found
        self.pairs = np.array(sorted(found), np.int64)
        self.merged = np.array([found[p] for p in self.pairs.tolist()], np.int32)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_PAIR if it has none or one of the two is missing (-1)."""
        if not len(self.pairs):
            return np.full(left.shape, NO_PAIR)
        wanted = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        known = (self.pairs[place] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.merged[place], NO_PAIR)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where those of each begin and end."""
        width = np.array([max(2, 1 << (len(p) - 1).bit_length()) for p in pieces], np.int64)
        number, done = np.zeros(len(pieces), np.int64), []
        for leaves in np.unique(width).tolist():
            alike = np.flatnonzero(width == leaves)
            step = 1 if leaves >= LONG else LEAVES // leaves
            for start in range(0, len(alike), step):
                part = alike[start : start + step]
                if leaves >= LONG:
                    tokens = self._merge_alone(pieces[part[0]], leaves)[None, :]
                else:
                    tokens = self._merge_alike([pieces[k] for k in part], leaves)
                number[part] = (tokens >= 0).sum(1)
                done.append((part, tokens[tokens >= 0]))
        ends = np.append(0, np.cumsum(number))
        ids = np.empty(ends[-1], np.int32)
        for part, tokens in done:
            own = number[part]
            inside = np.arange(len(tokens)) - np.repeat(np.cumsum(own) - own, own)
            ids[np.repeat(ends[part], own) + inside] = tokens
        return ids, ends

    def _merge_alike(self, pieces: list[bytes], leaves: int) -> np.ndarray:
        lengths = np.array([len(p) for p in pieces])
        filled = np.arange(leaves) < lengths[:, None]
        # A column behind the last holds no token.
        tokens = np.full((len(pieces), leaves + 1), -1, np.int32)
        tokens[:, :-1][filled] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (len(pieces), 1))
        after[:, -1] = leaves
        before = np.tile(np.arange(-1, leaves), (len(pieces), 1))
        tree = np.empty((len(pieces), 2 * leaves), np.int32)
        tree[:, leaves:] = self.of_pairs(tokens[:, :-1], tokens[:, 1:])
        low = leaves
        while low > 1:
            level = tree[:, low : 2 * low]
            tree[:, low // 2 : low] = np.minimum(level[:, ::2], level[:, 1::2])
            low //= 2
        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            rank = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < leaves:
                node = 2 * node + (tree[rows, 2 * node] != rank)
            left = node - leaves
            gone = after[rows, left]
            right = after[rows, gone]
            tokens[rows, left], tokens[rows, gone] = rank, -1
            after[rows, left], before[rows, right] = right, left
            self._write(tree, rows, gone, NO_PAIR)
            self._write(tree, rows, left, self.of_pairs(rank, tokens[rows, right]))
            first = before[rows, left]
            has = first >= 0
            some, first = rows[has], first[has]
            self._write(tree, some, first, self.of_pairs(tokens[some, first], rank[has]))
            rows = rows[tree[rows, 1] < NO_PAIR]
        return tokens

    def _merge_alone(self, piece: bytes, leaves: int) -> np.ndarray:
        """The same for one long piece, whose merges have nothing to wait for."""
        array = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.of_pairs(array[:-1], array[1:]).tolist()
        tokens, none = [*array.tolist(), -1], int(NO_PAIR)
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece)))
        tree = [none] * leaves + ranks + [none] * (leaves - len(ranks))
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def write(leaf: int, left: int, right: int) -> None:
            node, rank = leaf + leaves, self.rank_of.get(left << 32 | right, none)
            if left < 0 or right < 0:
                rank = none
            tree[node] = rank
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while (rank := tree[1]) < none:
            node = 1
            while node < leaves:
                node = 2 * node + (tree[2 * node] != rank)
            left = node - leaves
            gone = after[left]
            right = after[gone]
            tokens[left], tokens[gone] = rank, -1
            after[left], before[right] = right, left
            write(gone, -1, -1)
            write(left, rank, tokens[right])
            if before[left] >= 0:
                write(before[left], tokens[before[left]], rank)
        return np.array([t for t in tokens if t >= 0], np.int32)

    @staticmethod
    def _write(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value) -> None:
        if not len(rows):
            return
        node = leaf + tree.shape[1] // 2
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class ByteEncoder(RememberingEncoder):
    """Ids of whole texts as little-endian unsigned 32-bit numbers, without special tokens."""

    # Marks that are a piece of their own behind letters. An apostrophe is not.
    MARKS = (".", ",", "!", "?", ";", ":")

    def __init__(self, path: str, **options):
        super().__init__(**options)
        self.ranks = Ranks(path)
        self.piece = piece_pattern()
        # A space and what follows it up to white space is one or more pieces, and a run of
        # white space, but for the last if something follows, is one.
        self.word = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def split(self, text: str) -> list[str]:
        return self.word.findall(text)

    def pieces(self, word: str) -> list[str]:
        """The matches of the pattern in a word; plain letters and a mark need no pattern."""
        letters = word[1:] if word[0] == " " else word
        if letters.isascii():
            if letters.isalpha():
                return [word]
            if letters[-1:] in self.MARKS and letters[:-1].isalpha():
                return [word[:-1], word[-1]]
        return [word] if word.isspace() else self.piece.findall(word)

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        pieces = [self.pieces(word) for word in words]
        plain = [p.encode("utf-8", "surrogatepass") for ps in pieces for p in ps]
        ids, ends = self.ranks.merge(plain)
        data = ids.astype("<u4").tobytes()
        bounds = ends[np.append(0, np.cumsum([len(ps) for ps in pieces], dtype=np.int64))] * 4
        for word, start, end in zip(words, bounds[:-1].tolist(), bounds[1:].tolist()):
            yield word, data[start:end]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """`docs` with `ids` of each whole text (null: empty, no ids). Rows are encoded one by one;
    other columns stay, but for one that is named ids."""

    def make():
        own = encoder(ranks)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = list(own.column(batch.column("text")))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            values = np.frombuffer(b"".join(found), "<i4")
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]

        return compute

    return with_computed(docs, "ids array<int>", make)


def decode(rows: DataFrame, ranks: str) -> DataFrame:
    """`rows` with `decoded`, the bytes of their `ids` (null: null)."""

    def make():
        own = encoder(ranks)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = []
            for ids in batch.column("ids"):
                known = ids.values
                found.append(None if known is None else own.decode(known.to_numpy().tolist()))
            return [pa.array(found, pa.binary())]

        return compute

    return with_computed(rows, "decoded binary", make)
