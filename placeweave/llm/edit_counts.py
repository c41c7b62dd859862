"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree: blocks of them below, and above, for each
node, how many characters and tokens lie under it. The tree is stored with the document. An edit
finds its place by the characters of the subtrees, encodes again only the pre-tokens it touches with
the context that decides where they begin and end, and updates the sums above the blocks it changed.
"""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from placeweave.llm.byte_bpe import ByteEncoder
from placeweave.llm.rows import with_computed

# Pre-tokens in a block when a tree is built; a block of four times as many has the tree rebuilt.
BLOCK = 64
# Characters after a pre-token that its end may depend on.
LOOK_AHEAD = 2

Edit = tuple[int, int, str]


class PieceCounter(ByteEncoder):
    """For each pre-token of a text its characters and its tokens, as pairs of 32-bit numbers."""

    def __init__(self, path: str, **options):
        super().__init__(path, **options)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.library = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word in words:
            pairs = [(len(p), self.tokens_of(p)) for p in self.pieces(word)]
            yield word, np.array(pairs, "<u4").tobytes()

    def tokens_of(self, piece: str) -> int:
        return len(self.library.encode_ordinary(piece))

    def count(self, text: str) -> np.ndarray:
        return _pairs(self.encode([text])[0])


def _pairs(found: bytes) -> np.ndarray:
    return np.frombuffer(found, "<u4").astype(np.int64).reshape(-1, 2)


class Tree:
    """A text and the tree over its pre-tokens, as it was stored or, without `sizes`, built anew.

    `sizes` are the pre-tokens in each block, `sums` the characters and tokens below each node, the
    root at 1 and the children of k at 2k and 2k + 1. `encoded` counts characters encoded by edits,
    `touched` the sums that they changed.
    """

    def __init__(
        self,
        text: str,
        pairs: np.ndarray,
        counter: PieceCounter,
        sizes: np.ndarray | None = None,
        sums: np.ndarray | None = None,
    ):
        self.text, self.counter, self.encoded, self.touched = text, counter, 0, 0
        if sizes is None or sums is None:
            self._build(pairs)
        else:
            self._load(pairs, sizes, sums)

    def _build(self, pairs: np.ndarray) -> None:
        starts = np.arange(0, len(pairs), BLOCK)
        leaves = 1 << (max(1, len(starts)) - 1).bit_length()
        sizes = np.clip(len(pairs) - BLOCK * np.arange(leaves), 0, BLOCK)
        sums = np.zeros((2 * leaves, 2), np.int64)
        if len(starts):
            sums[leaves : leaves + len(starts)] = np.add.reduceat(pairs, starts, 0)
        level = leaves
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        self._load(pairs, sizes, sums)

    def _load(self, pairs: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> None:
        self.pairs, self.sizes, self.sums = pairs, sizes, sums
        self.leaves, self.ends = len(sizes), np.cumsum(sizes)
        self.changed: dict[int, list[list[int]]] = {}

    def block(self, k: int) -> list[list[int]]:
        if k in self.changed:
            return self.changed[k]
        return self.pairs[self.ends[k] - self.sizes[k] : self.ends[k]].tolist()

    def _set(self, node: int, total: list[int] | np.ndarray) -> None:
        self.sums[node] = total
        self.touched += 1

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_rows(self) -> np.ndarray:
        """The pre-tokens, as rows of characters and tokens."""
        parts, done = [], 0
        for k in sorted(self.changed):
            parts.append(self.pairs[done : self.ends[k] - self.sizes[k]])
            parts.append(np.array(self.changed[k], np.int64).reshape(-1, 2))
            done = self.ends[k]
        return np.concatenate([*parts, self.pairs[done:]])

    def block_sizes(self) -> np.ndarray:
        sizes = self.sizes.copy()
        for k, block in self.changed.items():
            sizes[k] = len(block)
        return sizes

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block with the character at `place`, and where that block starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            length = int(self.sums[node, 0])
            if place - start >= length and self.sums[node + 1, 0]:
                start += length
                node += 1
        return node - self.leaves, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from `start` to `end`; places beyond the text are its end."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        longer = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # The first pre-token whose end may have looked at a changed character.
        block, at = self._block_at(max(0, start - LOOK_AHEAD))
        first, k, here = block, 0, self.block(block)
        while k < len(here):
            length = here[k][0]
            if at + length > start - LOOK_AHEAD:
                break
            at, k = at + length, k + 1
        before, begin = here[:k], at
        # Encode on until a new pre-token starts where an old one did behind the edit.
        fresh: list[list[int]] = []
        place, old, rest = begin, begin, here[k:]
        changed = start + len(new)
        while place < len(self.text):
            while old + longer < place or old < end:
                while not rest and block + 1 < self.leaves:
                    block += 1
                    rest = self.block(block)
                if not rest:
                    break
                old, rest = old + rest[0][0], rest[1:]
            if place >= changed and old >= end and old + longer == place:
                break
            piece = self.counter.piece.match(self.text, place).group()
            fresh.append([len(piece), self.counter.tokens_of(piece)])
            self.encoded += len(piece)
            place += len(piece)
        else:
            rest, block = [], self.leaves - 1
        filled = self.sums[self.leaves + first + 1 : self.leaves + block + 1, 0]
        emptied = (np.flatnonzero(filled) + first + 1).tolist()
        self.changed.update((k, []) for k in emptied)
        if block == first:
            self.changed[first] = before + fresh + rest
        else:
            self.changed[first], self.changed[block] = before + fresh, rest
        if any(len(self.changed.get(k, [])) > 4 * BLOCK for k in (first, block)):
            self._build(self.leaf_rows())
            return
        nodes = {self.leaves + k for k in (first, block, *emptied)}
        for node in nodes:
            own = self.changed[node - self.leaves]
            self._set(node, [sum(p[0] for p in own), sum(p[1] for p in own)])
        while nodes := {node // 2 for node in nodes if node > 1}:
            for node in nodes:
                self._set(node, self.sums[2 * node] + self.sums[2 * node + 1])


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


_TREE = ("lengths", "counts", "block_sizes", "char_sums", "token_sums")
_STORED = ", ".join(f"{name} array<int>" for name in _TREE)
_EDITED = (
    "n_tokens_before long, n_tokens long, n_pre_tokens long, n_edits long, n_encoded_chars long, "
    f"n_changed_sums long, text string, {_STORED}"
)


def count(docs: DataFrame, ranks: str) -> DataFrame:
    """`docs` with the tree of each document: `lengths` and `counts` of its pre-tokens, how many
    are in each block, and the characters and tokens below each node.

    A null text counts as empty and has no pre-tokens. Rows that repeat a doc_id, and equal texts,
    are counted each. Other columns stay, but for those that have the name of a result.
    """

    def make():
        own = counter(ranks)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = list(own.column(batch.column("text")))
            return new_trees(_pairs(b"".join(found)), np.array([len(x) // 8 for x in found], np.int64))

        return compute

    return with_computed(docs, _STORED, make)


def new_trees(pairs: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """The trees of documents whose `n` pre-tokens follow one another in `pairs`, as they are stored
    and as `Tree` builds each of them."""
    blocks = -(-n // BLOCK)
    leaves = np.exp2(np.ceil(np.log2(np.maximum(1, blocks)))).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), blocks)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes, sums = np.zeros(leaves.sum(), np.int64), np.zeros((2 * leaves.sum(), 2), np.int64)
    first = np.cumsum(leaves) - leaves
    sizes[first[doc] + place] = np.minimum(BLOCK, n[doc] - BLOCK * place)
    if len(doc):
        starts = (np.cumsum(n) - n)[doc] + BLOCK * place
        sums[2 * first[doc] + leaves[doc] + place] = np.add.reduceat(pairs, starts, 0)
    for level in np.unique(leaves).tolist():
        root = 2 * first[leaves == level][:, None]
        while level > 1:
            nodes = np.arange(level // 2, level)
            sums[root + nodes] = sums[root + 2 * nodes] + sums[root + 2 * nodes + 1]
            level //= 2
    parts = [(pairs[:, 0], n), (pairs[:, 1], n), (sizes, leaves)]
    parts += [(sums[:, 0], 2 * leaves), (sums[:, 1], 2 * leaves)]
    return [_lists([values], counts) for values, counts in parts]


def _stored(trees: list[Tree]) -> list[pa.Array]:
    leaves, sums = [t.leaf_rows() for t in trees], [t.sums for t in trees]
    parts = [
        [x[:, 0] for x in leaves],
        [x[:, 1] for x in leaves],
        [t.block_sizes() for t in trees],
        [x[:, 0] for x in sums],
        [x[:, 1] for x in sums],
    ]
    return [_lists(part, np.array([len(x) for x in part], np.int64)) for part in parts]


def _lists(parts: list[np.ndarray], counts: np.ndarray) -> pa.Array:
    """Lists of so many numbers each, of the numbers of all parts in order."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def apply_edits(counted: DataFrame, ranks: str) -> DataFrame:
    """Apply `edits` (array of start, end, new) to the rows of `count`, one after another.

    Gives the counts before and after, the edited text, its tree, and how many characters were
    encoded and sums changed for the edits, so that later edits go on from there. Places count code
    points of the text as it is then; a null edit, or one with a null part, is left out.
    """

    def make():
        own = counter(ranks)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found, trees = [], []
            texts, edited = (batch.column(c).to_pylist() for c in ("text", "edits"))
            for text, edits, tree in zip(texts, edited, _read(batch, own)):
                tree.text = text or ""
                before, applied = tree.n_tokens, 0
                for edit in edits or []:
                    if edit is not None and None not in edit.values():
                        tree.edit(edit["start"], edit["end"], edit["new"])
                        applied += 1
                trees.append(tree)
                found.append((before, tree.n_tokens, applied, tree.encoded, tree.touched, tree.text))
            kinds = [pa.int64()] * 5 + [pa.string()]
            columns = zip(*found) if found else [[]] * len(kinds)
            made = [pa.array(x, k) for x, k in zip(columns, kinds)]
            kept = _stored(trees)
            n_pre_tokens = kept[0].value_lengths().cast(pa.int64())
            return [*made[:2], n_pre_tokens, *made[2:], *kept]

        return compute

    return with_computed(counted, _EDITED, make)


def _read(batch: pa.RecordBatch, own: PieceCounter) -> Iterator[Tree]:
    """The stored trees of a batch, without their texts."""
    columns = [batch.column(c) for c in _TREE]
    lengths, counts, sizes, chars, tokens = (c.flatten().to_numpy().astype(np.int64) for c in columns)
    pairs, sums = np.stack([lengths, counts], 1), np.stack([chars, tokens], 1)
    ends = [np.cumsum([0, *c.value_lengths().to_pylist()]).tolist() for c in columns[::2]]
    leaf, block, node = (zip(e, e[1:]) for e in ends)
    for (a, b), (c, d), (e, f) in zip(leaf, block, node):
        # The sums are changed in place, each tree's own.
        yield Tree("", pairs[a:b], own, sizes[c:d], sums[e:f])
