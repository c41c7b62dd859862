"""Token ids of whole texts, with a bounded memory of the words a worker has met."""

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# A worker remembers up to twice so many words, those it met last.
REMEMBERED_WORDS = 300_000
# Longer words are encoded anew each time.
LONGEST_WORD = 200
# Texts are encoded together until they have so many characters.
TOGETHER = 2_000_000


class RememberingEncoder:
    """Encodes texts as the results of their words in a row; results are bytes."""

    def __init__(self, remembered: int = REMEMBERED_WORDS):
        self.remembered = remembered
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        known = self.recent.__contains__
        missing = set(filterfalse(known, chain.from_iterable(split)))
        if len(self.recent) + len(missing) > self.remembered:
            self.older, self.recent = self.recent, {}
            missing = set(chain.from_iterable(split))
        unknown = []
        for word in missing:
            known = self.older.get(word)
            if known is None:
                unknown.append(word)
            else:
                self.recent[word] = known
        self.recent.update(self.learn(unknown))
        found = [b"".join(map(self.recent.__getitem__, words)) for words in split]
        for word in unknown:
            if len(word) > LONGEST_WORD:
                del self.recent[word]
        return found

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The result of each text of an Arrow column; a null text counts as empty."""
        together, size = [], 0
        for text in texts:
            together.append(text.as_py() or "")
            size += len(together[-1])
            if size >= TOGETHER:
                yield from self.encode(together)
                together, size = [], 0
        yield from self.encode(together)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the other
    bytes in order for the characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(byte if byte in printable else next(others)) for byte in range(256)]


class WordEncoder(RememberingEncoder):
    """Ids as little-endian unsigned 32-bit numbers, equal to `Tokenizer.encode` of the text.

    For tokenizers whose pre-tokens never reach over ASCII white space and whose normaliser
    treats the parts between them apart, so that a text's ids are those of its words in a row. Words
    of ASCII and Latin-1 letters go straight to the library's model, a pre-token at a time, if the
    tokenizer cuts and writes them as PIECES says; all others go through the whole tokenizer.
    """

    # Words that are remembered, in either of two turns, and bytes of texts that are encoded together.
    REMEMBERED, BLOCK = 400_000, 6_000_000
    # Words without white space, marks that combine, and letters whose lower case is disputed.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    # The pre-tokens of such a word in lower case.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    SPECIAL = "<|"
    PROBES = (
        *map(chr, [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]),
        "Word,", "it's", "IT'S", "we'll-they'd", "o'clock", "a1b22", "...!?", "'tis", "l'été", "ÀÉÎßÿ",
        "don't.", "$$$x###", "(x)", "e-mail@x.org", "'re're", "x'", "'", "STRASSE", "Straße,",
    )

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.direct = all(self._in_pieces(w) == self._whole(w) for w in self.PROBES)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.column(pa.array(texts, pa.string())))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.fill_null("")
        together, size = 0, 0
        for at, length in enumerate(pc.binary_length(texts).to_pylist()):
            if size + length > self.BLOCK and at > together:
                yield from self._block(texts.slice(together, at - together))
                together, size = at, 0
            if length > self.BLOCK:
                yield b"".join(self._block(pa.array(_parts(texts[at].as_py(), self.BLOCK), pa.string())))
                together, size = at + 1, 0
            else:
                size += length
        yield from self._block(texts.slice(together))

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of some texts: each distinct word is looked up once, the rest are arrays."""
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        known = self._known(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        codes = words.indices.to_numpy()
        numbers = lengths[codes]
        ends = np.cumsum(numbers)
        places = np.arange(ends[-1] if len(ends) else 0)
        places += np.repeat((np.cumsum(lengths) - lengths)[codes] - (ends - numbers), numbers)
        data = ids[places].tobytes()
        stops = np.append(0, ends)[np.cumsum(cut.value_lengths().to_numpy())] * 4
        start = 0
        for stop in stops.tolist():
            yield data[start:stop]
            start = stop

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; those met last are remembered."""
        found = list(map(self.recent.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        unknown = []
        for k in missing:
            found[k] = self.older.get(words[k])
            if found[k] is None:
                unknown.append(k)
        for k, (_, ids) in zip(unknown, self.learn([words[k] for k in unknown])):
            found[k] = ids
        if len(self.recent) + len(missing) > self.remembered:
            self.older, self.recent = self.recent, {}
        self.recent.update((words[k], found[k]) for k in missing if len(words[k]) <= LONGEST_WORD)
        return found

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _in_pieces(self, word: str) -> bytes:
        return b"".join(map(self._piece, self.PIECES.findall(word.lower())))

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = piece
            if not piece.isascii():
                letters = "".join([self.letters[byte] for byte in piece.encode()])
            found = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
            if len(self.pieces) >= self.remembered:
                self.pieces.clear()
            if len(piece) <= LONGEST_WORD:
                self.pieces[piece] = found
        return found

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word in words:
            if not self.direct:
                yield word, self._whole(word)
            elif word.isascii() and word.isalpha():
                yield word, self._piece(word.lower())
            elif self.PLAIN.fullmatch(word) and self.SPECIAL not in word:
                yield word, self._in_pieces(word)
            else:
                yield word, self._whole(word)


def _parts(text: str, size: int) -> list[str]:
    """A long text in parts of about `size` characters that end before white space."""
    ends = [0]
    while found := _SPACE.search(text, ends[-1] + size):
        ends.append(found.start())
    return [text[a:b] for a, b in zip(ends, [*ends[1:], len(text)])]


_SPACE = re.compile("[ \t\n\v\f\r]")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
