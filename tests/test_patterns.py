"""Required literals: every match contains one of them."""

import random
import re

import pytest

from placeweave.functions.patterns import required_literals


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("plain", ["plain"]),
        ("ab+c", ["ab"]),
        ("abc*de", ["ab"]),
        ("a?bcd{0,2}", ["bc"]),
        ("one|three+|x", ["one", "three", "x"]),
        ("one|t*", None),
        (r"https?://x\.org/[a-z]+\d{3}", ["://x.org/"]),
        (r"(?:abc|d)efg", ["efg"]),
        (r"(?:abcd)+e", ["abcd"]),
        (r"(abcd)?e", ["e"]),
        (r"(?=abcd)e", ["e"]),
        (r"(?<n>abcd)\k<n>", ["abcd"]),
        (r"\Qa|b(\Ec", ["a|b(c"]),
        (r"\x41bcA\p{L}d", ["bcA"]),
        ("(?i)abc", None),
        ("[]a]bc", None),
        ("[^]a]bc", None),
        ("[a[bc]&&[^b]]xy", ["xy"]),
        (r"a\101", None),
        ("(abc", None),
        ("abc)", None),
        ("", None),
        (".*", None),
    ],
)
def test_required_literals(pattern, expected):
    assert required_literals(pattern) == expected


def test_matches_of_random_patterns_contain_a_literal():
    draw = random.Random(5)

    def some(depth):
        parts = []
        for _ in range(draw.randint(1, 4)):
            kind = draw.randint(0, 6)
            part = draw.choice("abc")
            if kind == 1:
                part = draw.choice([".", "[ab]", "[^a]", r"\w", r"\.", "^", "$"])
            elif kind == 2 and depth:
                part = draw.choice(["(", "(?:", "(?=", "(?!"]) + some(depth - 1) + ")"
            if draw.random() < 0.3 and part not in ("^", "$") and not part.startswith(("(?=", "(?!")):
                part += draw.choice(["?", "*", "+", "{2}", "{0,1}", "+?"])
            parts.append(part)
        return "".join(parts) + ("|" + some(depth - 1) if depth and draw.random() < 0.2 else "")

    read = matched = 0
    for _ in range(3_000):
        pattern = some(2)
        literals = required_literals(pattern)
        if literals is None:
            continue
        read += 1
        for _ in range(30):
            text = "".join(draw.choice("abc.") for _ in range(draw.randint(0, 8)))
            if re.search(pattern, text):
                matched += 1
                assert any(x in text for x in literals), (pattern, literals, text)
    assert read > 1_000 and matched > 5_000
