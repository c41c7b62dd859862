"""Column names of the place table. Every place column is a nullable string."""

# The flat record layout that the extraction jobs produce.
PLACE_COLUMNS = [
    "subject",
    "locationName",
    "locationType",
    "fullAddress",
    "thoroughfare",
    "huisnummer",
    "busnummer",
    "postCode",
    "city",
    "gml",
    "point",
    "bron",
    "udbLocationType",
]

# The same record without the catalogue type, in the order most sources list it.
RECORD_COLUMNS = [
    "subject",
    "locationName",
    "locationType",
    "thoroughfare",
    "huisnummer",
    "busnummer",
    "fullAddress",
    "postCode",
    "city",
    "gml",
    "point",
    "bron",
]

# Columns that deduplication compares.
KEY_COLUMNS = ["locationName", "locationType", "thoroughfare", "huisnummer", "postCode", "city"]

VERDICT_COLUMNS = ["certainty_ratio", "is_duplicate", "duplicate_subject"]
