"""String rules for names, postcodes and titles, as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in patterns; Java's \s leaves out the four separators.
SPACE = r"[\s\x1c-\x1f]"
# White space as a Unicode-aware strip() sees it.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Letters with case, those that Java's patterns do not know yet written out.
CASED = (
    r"a-zA-Z\p{IsUppercase}\p{IsLowercase}\p{Lt}\u10FC\u2C2F\u2C5F\uA7C0-\uA7C1\uA7D0-\uA7D1\uA7D3"
    r"\uA7D5-\uA7D9\uA7F2-\uA7F4\uAB69\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}"
    r"\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}"
    r"\x{10780}\x{10783}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}\x{1DF00}-\x{1DF09}"
    r"\x{1DF0B}-\x{1DF1E}\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}"
)
# Signs that do not part a word where the case of its letters is decided.
CASE_IGNORABLE = (
    r"\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}'.:\u00B7\u0387\u055F\u05F4\u2018\u2019\u2024\u2027"
    r"\uFE13\uFE52\uFE55\uFF07\uFF0E\uFF1A"
)
# Put before a letter that starts a run within a word; a Unicode noncharacter, so never text.
_RUN_MARK = "\ufdd0 "


def strip(text: Column) -> Column:
    """The text without white space at its ends, in time that grows with its length."""
    return F.trim(text, F.lit(STRIPPED))


def strip_quotes(text: Column) -> Column:
    """Take off one pair of equal quotes around the text; a lone quote becomes empty."""
    return F.regexp_replace(text, r"""(?s)\A(['"])(.*)\1\z|\A['"]\z""", "$2")


def clean_name(name: Column, null_name_text: str | None = None) -> Column:
    """Cleaned location name. The order of the rules matters.

    Each rule reads the text before it once: a rule that names it twice, as CASE does, would
    make Spark work out all earlier rules twice. `null_name_text` is what a missing name turns
    into; by default it stays null.
    """
    if null_name_text is not None:
        name = F.coalesce(name, F.lit(null_name_text))
    name = F.regexp_replace(name, r"\p{Nd}", "")
    name = F.translate(name, "’‘“”", "''\"\"")
    name = F.replace(name, F.lit("'T"), F.lit("'t"))
    # An escaped apostrophe (&#039;t) has lost its digits by now.
    name = F.replace(name, F.lit("&#;t"), F.lit("'t"))
    # A run of spaces and of ? / - becomes one space, none at the ends. So a text of just / or ?
    # gets empty here, and a text of just ' in the last rule.
    name = F.trim(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f?/-]+", " "))
    return strip_quotes(name)


def drop_decimal_zero(text: Column) -> Column:
    """`9000.0` -> `9000`, of any length; what is not a whole number with `.0` stays."""
    shaped = text.rlike(r"\A\s*[+-]?\d*\.0\z")
    whole = F.regexp_replace(text, r"\A\s*\+?(-?)0*(\d*)\.0\z", "$1$2")
    return F.when(shaped, F.when(whole.isin("", "-"), "0").otherwise(whole)).otherwise(text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others.

    `initcap` starts a word only after a space, so a marked space goes in front of a run that
    follows any other sign. A capital sigma is not final if a letter follows behind signs that do
    not part a word; behind the mark `initcap` would not see that letter, so it gets a small one.
    """
    sigma = rf"\u03A3(?=[{CASE_IGNORABLE}]++[{CASED}])"
    text = F.regexp_replace(text, sigma, "\u03c3")
    marked = F.regexp_replace(text, rf"[^{CASED} ]+(?=[{CASED}])", "$0" + _RUN_MARK)
    return F.replace(F.initcap(marked), F.lit(_RUN_MARK), F.lit(""))


def null_if_blank_token(text: Column, tokens: list[str]) -> Column:
    return F.when(~text.isin(tokens), text)
