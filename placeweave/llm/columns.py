"""Column expressions and sizes that several operators share."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.operators.skew import HOT_ROWS


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and every other letter as it is."""
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(letters)


def hot_rows(total: int) -> int:
    """From how many rows on a key of a table of `total` rows is hot: a thousandth of them.

    So a table has a thousand hot keys at most, or one for each HOT_ROWS rows.
    """
    return min(HOT_ROWS, max(1_000, total // 1_000))
