"""Token-sort similarity (0-100) and lossless signatures for joining similar strings.

With sorted strings of la and lb characters and a longest common subsequence of c characters,
the score is 200*c/(la+lb). A score of at least `min_score` therefore means at most
(100-min_score)*(la+lb)/100 insertions and deletions, and neither string can be longer than
(200-min_score)/min_score times the other.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from placeweave.functions.text import SPACE, strip


def sort_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(text), rf"(?U){SPACE}+")), " ")


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, null where a text is null.

    Bit i of `open_` is cleared once the common subsequence grows at character i of a, so a whole
    row of the usual table is one integer step. As a nested aggregate over arrays of characters
    the same takes some fifty times as long.
    """

    def length(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        places: dict[str, int] = {}
        for i, char in enumerate(x):
            places[char] = places.get(char, 0) | 1 << i
        full = open_ = (1 << len(x)) - 1
        for char in y:
            hits = open_ & places.get(char, 0)
            open_ = ((open_ + hits) | (open_ - hits)) & full
        return len(x) - open_.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="Int32")


# Up to this edit distance, the distance may tell the longest common subsequence.
FEW_EDITS = 8


def common_length(a: Column, b: Column) -> Column:
    """As `lcs_length`, which only sees the pairs that the edit distance leaves open.

    The distance is never less than the difference of the lengths. If it is just that, one text is
    a subsequence of the other; if it is one more, it must hold one replacement and no insertion
    with a deletion, and all but one character of the shorter text are common.
    """
    shorter = F.least(F.char_length(a), F.char_length(b))
    apart = F.abs(F.char_length(a) - F.char_length(b))
    more = F.levenshtein(a, b, FEW_EDITS) - apart
    known = F.when(a == b, shorter).when((apart <= FEW_EDITS) & more.isin(0, 1), shorter - more)
    return F.coalesce(known, lcs_length(F.when(known.isNull(), a), F.when(known.isNull(), b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts after sorting their tokens, 0 to 100."""
    a, b = sort_tokens(a), sort_tokens(b)
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_length(a, b) / total)


def letters(text: Column) -> Column:
    """Which characters a text has: bit k of `once` (`twice`) is set if the characters that fall
    on k occur at least once (twice)."""

    def add(seen: Column, char: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(char) % 64)
        return F.struct(
            seen["once"].bitwiseOR(bit).alias("once"),
            seen["twice"].bitwiseOR(seen["once"].bitwiseAND(bit)).alias("twice"),
        )

    none = F.lit(0).cast("bigint")
    return F.aggregate(F.split(text, ""), F.struct(none.alias("once"), none.alias("twice")), add)


def profile(text: Column, when: Column | None = None) -> Column:
    """What `may_be_similar` needs of a token-sorted string.

    The letters pay only where a string meets many others; where `when` does not hold they are
    left out, and not tested.
    """
    known = letters(text) if when is None else F.when(when, letters(text))
    return F.struct(
        text.alias("text"), F.char_length(text).alias("length"), known.alias("letters")
    )


def may_be_similar(a: Column, b: Column, min_score: int) -> Column:
    """Whether two profiles let their strings score `min_score`; cheap tests come first.

    Each insertion or deletion changes the length by one and a letter bit at most, and the edit
    distance is never more than the number of insertions and deletions.
    """
    total = a["length"] + b["length"]
    room = (100 - min_score) * total

    def changed(bits: str) -> Column:
        count = F.bit_count(a["letters"][bits].bitwiseXOR(b["letters"][bits]))
        return F.coalesce(count, F.lit(0))

    return (
        (100 * F.abs(a["length"] - b["length"]) <= room)
        & (100 * (changed("once") + changed("twice")) <= room)
        & (100 * F.levenshtein(a["text"], b["text"]) <= room)
    )


def is_surely_similar(a: Column, b: Column, min_score: int) -> Column:
    """Whether the edit distance alone says that two profiles' strings score `min_score`.

    An edit is at most two insertions and deletions. That settles most pairs that may be similar.
    """
    room = (100 - min_score) * (a["length"] + b["length"])
    return 200 * F.levenshtein(a["text"], b["text"]) <= room


def is_similar(a: Column, b: Column, min_score: int) -> Column:
    """Whether the strings of two profiles score `min_score`, by their common subsequence."""
    common = lcs_length(a["text"], b["text"])
    return 200 * common >= min_score * (a["length"] + b["length"])


# Characters in a gram. An insertion or deletion destroys at most so many grams of a string.
GRAM = 3


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once however often it is named, also in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numbered_grams(text: Column) -> Column:
    """The substrings of GRAM characters, each with its number among the equal ones.

    Equal grams are next to each other once sorted, so each run of them is numbered by itself and
    the work grows with the text, but for the sorting.
    """

    def grams(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - GRAM)
        parts = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
        return F.array_sort(parts)

    def numbered(ordered: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return _once(first, lambda starts: runs(ordered, starts))

    def runs(ordered: Column, starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            count = F.coalesce(F.get(starts, k + 1), F.size(ordered)) - start
            numbers = F.sequence(F.lit(1), count)
            return F.transform(numbers, lambda n: F.concat(F.get(ordered, start), n.cast("string")))

        return F.flatten(F.transform(starts, run))

    found = _once(F.split(text, ""), lambda chars: _once(grams(chars), numbered))
    return F.when(F.char_length(text) >= GRAM, found).otherwise(F.array().cast("array<string>"))


def allowed_edits(a: Column, b: Column, min_score: int) -> Column:
    """The insertions and deletions that strings of `a` and `b` characters may differ in; where the
    lengths alone are further apart, a number below that difference."""
    most = F.floor((100 - min_score) * (a + b) / 100).cast("int")
    # Insertions and deletions are as odd or even in number as the lengths are apart.
    return most - F.pmod(most - F.abs(a - b), F.lit(2))


def signatures(text: Column, rarest: Column, min_score: int, is_match: bool) -> Column:
    """Keys of a token-sorted string, of which it shares one with each similar string, each with
    its place `at` among the string's grams: structs (key, at).

    `rarest` has its numbered grams, structs (gram, common), in an order that all strings follow.
    Similar strings that may differ in d edits differ in GRAM * d grams at most, so the first gram
    they share is one of the first GRAM * d + 1 of both. A string gives as many as the largest d
    that its length allows, so its keys grow with its length, and `may_meet` holds the pair to its
    own d. A `common` gram, which so many hold that they should not all meet, is joined with the
    length of the original: a match gives it for the lengths whose d reaches its place. A pair of
    lengths at which strings may share no gram, which only short ones have, is a key of its own.
    """
    length = F.char_length(text)
    shortest = F.ceil(min_score * length / (200 - min_score)).cast("int")
    longest = F.floor((200 - min_score) * length / min_score).cast("int")

    def option(other: Column) -> Column:
        edits = allowed_edits(length, other, min_score)
        few = F.least(length, other) - GRAM + 1 <= GRAM * edits
        return F.struct(other.alias("other"), edits.alias("edits"), few.alias("few"))

    def keys(options: Column) -> Column:
        def by_lengths(o: Column) -> Column:
            pair = F.concat_ws(":", *((length, o["other"]) if is_match else (o["other"], length)))
            return F.struct(pair.alias("key"), F.lit(0).alias("at"))

        def by_gram(held: Column, at: Column) -> Column:
            lengths = F.array(length)
            if is_match:
                reached = F.filter(shared, lambda o: GRAM * o["edits"] >= at)
                lengths = F.transform(reached, lambda o: o["other"])
            gram = F.concat(F.lit(":"), held["gram"])
            with_length = F.transform(lengths, lambda n: F.concat_ws(":", gram, n))
            found = F.when(held["common"], with_length).otherwise(F.array(gram))
            return F.transform(found, lambda key: F.struct(key.alias("key"), at.alias("at")))

        shared = F.filter(options, lambda o: ~o["few"])
        reach = F.array_max(F.transform(shared, lambda o: GRAM * o["edits"] + 1))
        first = F.slice(rarest, F.lit(1), F.coalesce(reach, F.lit(0)))
        pairs = F.transform(F.filter(options, lambda o: o["few"]), by_lengths)
        return F.concat(pairs, F.flatten(F.transform(first, by_gram)))

    options = F.transform(F.sequence(shortest, longest), option)
    possible = F.filter(options, lambda o: o["edits"] >= F.abs(length - o["other"]))
    return _once(possible, keys)


def may_meet(a: Column, b: Column, a_at: Column, b_at: Column, min_score: int) -> Column:
    """Whether profiles that share a key at these places may share their first gram there.

    Similar strings pass at the first gram they share, so no pair is lost.
    """
    last = GRAM * allowed_edits(a["length"], b["length"], min_score)
    return (a_at <= last) & (b_at <= last)
