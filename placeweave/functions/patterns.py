"""What a regular expression says about the texts that it can match."""

import re

# Escapes that match no fixed character, and how many characters belong to them.
_OPEN_ESCAPES = dict.fromkeys("dDwWsShHvVRXbBAzZGtnrfae", 0) | {"c": 1, "u": 4, "x": 2}
_REPEATED = re.compile(r"[?*+]|\{(\d+)(?:,\d*)?\}")


class _Unclear(Exception):
    """The pattern has a part that this module does not read."""


def required_literals(pattern: str) -> list[str] | None:
    """Texts of which every match of `pattern` contains one, or None if there may be others.

    Reads the syntax of Java's expressions, and gives up (None) at flags, back references by number
    past nine and anything else it is not sure of. One text for each alternative, the longest one.
    """
    try:
        found, end = _alternatives(pattern, 0)
    except (_Unclear, IndexError):
        return None
    return found if end == len(pattern) and found and all(found) else None


def _alternatives(pattern: str, at: int) -> tuple[list[str], int]:
    """The longest required text of each alternative from `at` to the end of its group; one is empty
    if nothing is required."""
    found = []
    while True:
        text, at = _sequence(pattern, at)
        found.append(text)
        if at == len(pattern) or pattern[at] == ")":
            return found, at
        at += 1  # the bar


def _sequence(pattern: str, at: int) -> tuple[str, int]:
    runs = [""]
    while at < len(pattern) and pattern[at] not in "|)":
        if pattern.startswith(r"\Q", at):
            end = pattern.find(r"\E", at)
            end = len(pattern) if end < 0 else end
            text, at = pattern[at + 2 : end], min(end + 2, len(pattern))
            if _REPEATED.match(pattern, at):
                raise _Unclear
            runs[-1] += text
            continue
        text, joins, at = _atom(pattern, at)
        repeated = _REPEATED.match(pattern, at)
        if repeated:
            at = repeated.end()
            if pattern[at : at + 1] in ("?", "+"):
                at += 1
            if repeated[0] in "?*" or repeated[1] and int(repeated[1]) == 0:
                text = ""
            if joins:
                runs[-1] += text  # once at least, so the run may go up to it
            else:
                runs.append(text)
            runs.append("")
        elif joins:
            runs[-1] += text
        else:
            runs += [text, ""]
    return max(runs, key=len), at


def _atom(pattern: str, at: int) -> tuple[str, bool, int]:
    """A required text of the next element, whether that is all it matches, and its end."""
    sign = pattern[at]
    if sign == "\\":
        return _escape(pattern, at + 1)
    if sign == "[":
        return "", False, _class_end(pattern, at)
    if sign == "(":
        return _group(pattern, at + 1)
    if sign in ".^$":
        return "", False, at + 1
    if sign in "?*+{":
        raise _Unclear
    return sign, True, at + 1


def _escape(pattern: str, at: int) -> tuple[str, bool, int]:
    sign = pattern[at]
    if not (sign.isascii() and sign.isalnum()):
        return sign, True, at + 1
    if sign in "pPNk" or pattern[at : at + 2] == "x{":
        named = re.compile(r"\{[^}]*\}|<[^>]*>|[A-Z]").match(pattern, at + 1)
        if not named:
            raise _Unclear
        return "", False, named.end()
    if sign in "123456789" and not pattern[at + 1 : at + 2].isdigit():
        return "", False, at + 1
    if sign in _OPEN_ESCAPES:
        return "", False, at + 1 + _OPEN_ESCAPES[sign]
    raise _Unclear


def _group(pattern: str, at: int) -> tuple[str, bool, int]:
    required = True
    if pattern[at] == "?":
        opening = re.compile(r"\?(?::|>|<[A-Za-z][A-Za-z0-9]*>|(<?[=!]))").match(pattern, at)
        if not opening:
            raise _Unclear  # flags
        at, required = opening.end(), not opening[1]
    found, at = _alternatives(pattern, at)
    if pattern[at] != ")":
        raise _Unclear
    # What a group of one alternative requires stands for itself; it may be more than the text.
    return found[0] if required and len(found) == 1 else "", False, at + 1


def _class_end(pattern: str, at: int) -> int:
    """The end of a class, which may hold other classes, escapes and quoted texts."""
    depth = 0
    while True:
        sign = pattern[at]
        if sign == "\\":
            if pattern[at + 1] in "QE":
                raise _Unclear
            at += 1
        elif sign == "[":
            depth += 1
            at += pattern[at + 1] == "^"
            if pattern[at + 1] == "]":
                raise _Unclear
        elif sign == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
