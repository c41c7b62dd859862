"""Line-first cleaning: lines that break a rule go; documents that lose too much go with them."""

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from placeweave.llm.rows import with_computed

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# A document needs this many words, and at most this share of them in repeated 5-word windows.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20

# Punctuation: a line fails with at least so many marks, and more than this share of its letters.
MARKS, LEAST_MARKS, MOST_MARKS_PERCENT = SYMBOLS + "!{}=~^\\", 6, 12
# Navigation: a line fails with so many separators standing alone, and one per so many words.
SEPARATORS, LEAST_SEPARATORS, WORDS_PER_SEPARATOR = frozenset("|>»›·•/") | {"::", "->"}, 3, 5
# Boilerplate: phrases of site furniture and licences that make up so much of a line's letters, and
# lines that go round in a few words.
PHRASES = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "subscribe to our newsletter",
    "click here to",
    "permission is hereby granted",
    "licensed under the",
)
LEAST_PHRASE_PERCENT = 5
# A line goes round if words, or 5-word windows of a line longer than a stretch, occur so many times
# on average. Words are counted in stretches of one length, as any text repeats its words by and by.
LEAST_ROUND, WORDS_PER_DISTINCT, STRETCH = 12, 3, 500
# A document is rejected if less than this share of its word characters is left.
LEAST_LEFT_PERCENT = 50

_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines_removed long, kept boolean, clean_text string"
)


def word_characters(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    seen: dict[tuple, int] = {}
    again = []
    if len(set(windows)) < len(windows):
        for place, window in enumerate(windows):
            first = seen.setdefault(window, place)
            if first != place:
                again += (first, place)
    return len(set(chain.from_iterable(range(p, p + WINDOW) for p in again)))


def goes_round(words: list[str]) -> bool:
    """Whether a line repeats a few words throughout, or the same passage. The last stretch of a
    long line ends with it."""
    if len(words) < LEAST_ROUND:
        return False
    last = max(0, len(words) - STRETCH)
    stretches = [words[k : k + STRETCH] for k in (*range(0, last, STRETCH), last)]
    if sum(len(set(s)) for s in stretches) * WORDS_PER_DISTINCT <= sum(map(len, stretches)):
        return True
    if not last:
        return False
    windows = set(zip(*(words[k:] for k in range(WINDOW))))
    return len(windows) * WORDS_PER_DISTINCT <= len(words) - WINDOW + 1


def line_passes(line: str, low: str) -> bool:
    """Whether a line breaks no rule. `low` is the line in lower case."""
    marks = sum(map(line.count, MARKS))
    if marks >= LEAST_MARKS and marks * 100 > MOST_MARKS_PERCENT * word_characters(line):
        return False
    words = low.split()
    alone = sum(w in SEPARATORS for w in words)
    if alone >= LEAST_SEPARATORS and alone * WORDS_PER_SEPARATOR >= len(words):
        return False
    if goes_round(words):
        return False
    said = sum(low.count(phrase) * word_characters(phrase) for phrase in PHRASES)
    return not said or said * 100 < LEAST_PHRASE_PERCENT * word_characters(low)


def judge(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    filled = [line for line in lines if line.strip(SPACES)]
    size = word_characters(text)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
    # A blank line breaks no rule.
    left = [line for line in lines if line_passes(line, line.lower())]
    clean = "\n".join(left)
    enough = word_characters(clean) * 100 >= LEAST_LEFT_PERCENT * size
    return (
        len(words),
        size,
        sum(map(text.count, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated,
        failed,
        len(lines) - len(left),
        enough and not failed,
        clean,
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the figures of each whole text, the verdict `kept`, and `clean_text`.

    A null text counts as empty, has fewer words than a document needs, and so is not kept. Other
    columns stay, but for those that have the name of a result. Rows are judged one by one.
    """
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [judge(text) for text in batch.column("text").to_pylist()]
        columns = zip(*found) if found else [[]] * len(kinds)
        return [pa.array(x, k) for x, k in zip(columns, kinds)]

    return with_computed(docs, _COLUMNS, lambda: compute)
