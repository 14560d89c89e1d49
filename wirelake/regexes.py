"""Regular expressions of ``matches``: the dialect that is accepted, and its exact form for the JVM.

The contract is that of byte strings: a pattern is searched, not anchored, in the UTF-8 bytes of the value, with ASCII case folded.
"""

from __future__ import annotations

import re

_BRACES = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
_LOOK = ("?=", "?!", "?<=", "?<!")
MAX_COUNT = 65_535
#: Repeats of a group with alternatives or quantifiers inside, beyond which the JVM's matcher may overflow its stack.
DEEP = 200
_W = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_NO_EDGE = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"


def pieces(pattern: str):
    """(kind, text, place): kinds are escape, class-open, class-escape, class-char, class-close, open, close, count, quantifier, char."""
    i, n, inside, fresh = 0, len(pattern), False, False
    while i < n:
        c = pattern[i]
        if c == "\\":
            width = 4 if pattern[i + 1 : i + 2] == "x" else 2
            yield ("class-escape" if inside else "escape"), pattern[i : i + width], i
            i, fresh = i + width, False
        elif inside:
            if c == "]" and not fresh:
                inside = False
                yield "class-close", c, i
            else:
                yield "class-char", c, i
            i, fresh = i + 1, False
        elif c == "[":
            text = "[^" if pattern[i + 1 : i + 2] == "^" else "["
            inside = fresh = True
            yield "class-open", text, i
            i += len(text)
        elif c == "(":
            prefix = next((p for p in ("?:", *sorted(_LOOK, key=len, reverse=True)) if pattern.startswith(p, i + 1)), "")
            yield "open", c + prefix, i
            i += 1 + len(prefix)
        elif c == ")":
            yield "close", c, i
            i += 1
        elif c == "{" and (m := _BRACES.match(pattern, i)):
            yield "count", m[0], i
            i = m.end()
        else:
            yield ("quantifier" if c in "*+?" else "char"), c, i
            i += 1


def validate(pattern: str) -> None:
    """ValueError unless all of the pattern means the same to the common engines."""

    def no(at: int, why: str):
        raise ValueError(f"{pattern!r}, place {at}: {why}")

    after_quantifier = False
    for kind, text, at in pieces(pattern):
        quantifier = False
        if kind in ("escape", "class-escape"):
            c = text[1:2]
            if c == "x" and not re.fullmatch(r"\\x[0-9a-fA-F]{2}", text):
                no(at, "\\x takes two hex digits")
            if c.isalnum() and c != "x" and c not in ("dDwWsSnrtf" if kind == "class-escape" else "dDwWsSnrtfbB"):
                no(at, f"engines differ on the escape {text}")
        elif kind == "class-char" and text == "[":
            no(at, "engines differ on [ in a class; write \\[")
        elif kind == "open" and text == "(" and pattern[at + 1 : at + 2] == "?":
            no(at, "engines differ on this kind of group")
        elif kind == "char" and text == "{":
            no(at, "{ that isn't a count; write \\{")
        elif kind == "count":
            if any(int(x) > MAX_COUNT for x in re.findall(r"[0-9]+", text)):
                no(at, f"counts beyond {MAX_COUNT} aren't accepted everywhere")
            quantifier = True
        elif kind == "quantifier":
            if text == "+" and after_quantifier:
                no(at, "possessive quantifiers aren't known everywhere")
            quantifier = not (after_quantifier and text == "?")
        after_quantifier = quantifier
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"{pattern!r} isn't a regular expression: {e}") from None


def wants_bytes(pattern: str) -> bool:
    """Whether the answer on characters could differ from that on UTF-8 bytes.

    It can't where everything that the pattern takes is a listed ASCII character.
    """
    if not pattern.isascii():
        return True
    for kind, text, _ in pieces(pattern):
        if kind == "char" and text == "." or kind == "class-open" and text == "[^" or kind == "open" and text[1:] in _LOOK:
            return True
        if kind in ("escape", "class-escape") and (text[1:2] in "DWSB" or text[1:2] == "x" and int(text[2:], 16) > 127):
            return True
    return False


def for_jvm(pattern: str) -> str:
    """The pattern for java.util.regex, to be searched in a string that has one character for each byte."""
    out = []
    fresh = False
    for kind, text, _ in pieces(pattern.encode("utf-8").decode("latin-1")):
        if kind == "escape" and text in ("\\b", "\\B"):
            text = _EDGE if text == "\\b" else _NO_EDGE
        elif kind == "class-char" and (text == "&" or text == "]" and fresh):
            text = "\\" + text
        elif kind == "char" and text == "$":
            text = "(?=\\n?\\z)"  # before a newline at the very end, as in Python
        out.append(text)
        fresh = kind == "class-open"
    return "(?id)" + "".join(out)


def overflows(pattern: str) -> bool:
    """Whether the JVM's matcher would recurse once for each repeat of a group, as it does if the group's body varies."""
    stack: list[bool] = [False]
    closed: bool | None = None
    for kind, text, _ in pieces(pattern):
        repeat = kind == "count" or kind == "quantifier"
        if closed is not None:
            many = text in ("*", "+") or kind == "count" and (text.endswith(",}") or max(map(int, re.findall(r"[0-9]+", text))) > DEEP)
            if repeat and many and closed:
                return True
            stack[-1] |= closed
        closed = None
        if kind == "open":
            stack.append(False)
        elif kind == "close" and len(stack) > 1:
            closed = stack.pop()
        elif repeat or kind == "char" and text == "|":
            stack[-1] = True
    return False


def unportable(pattern: str) -> str | None:
    """Why a linear-time matcher would refuse the pattern; None if it wouldn't. Only strict mode asks."""
    if not pattern.isascii():
        return "characters beyond ASCII fold differently"
    sizes: list[list[int]] = [[]]
    inner: list[int] | None = None
    for kind, text, at in pieces(pattern):
        if kind == "count":
            low, high = (int(x) if x else 0 for x in (_BRACES.match(text)[1], _BRACES.match(text)[3]))
            times = max(1, low, high)
            if times > 1000:
                return f"the count at {at} is beyond 1000"
            inner = [times * x for x in inner or [1]]
            if max(inner) > 1000:
                return f"nested counts at {at} come to more than 1000"
        if inner is not None:
            sizes[-1] += inner
            inner = None
        if kind == "open":
            if text[1:] in _LOOK:
                return f"lookaround at {at}"
            sizes.append([])
        elif kind == "close" and len(sizes) > 1:
            inner = sizes.pop()
    return None
