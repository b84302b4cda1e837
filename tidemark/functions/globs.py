"""Four glob dialects as regular expressions, translated once when a plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A token of a dialect: what it looks like, and its regular expression (or a function of the match).
Token = tuple[str, str | Callable[[re.Match], str]]


def _set_token(negators: str) -> Token:
    """``[...]``; a ``]`` right behind the bracket (or the negator) is a member, and a set that never closes is literal."""

    def regex(m: re.Match) -> str:
        inverted, members = re.fullmatch(rf"\[([{re.escape(negators)}]?)(.*)\]", m[0], re.S).groups()
        return f"[{'^' if inverted else ''}{re.sub(r'[^\w-]', r'\\\g<0>', members)}]"

    return rf"\[[{re.escape(negators)}]?+\]?+[^\]]*+\]", regex


def _translate(pattern: str, tokens: list[Token]) -> str:
    """``pattern`` with each token replaced, the first that fits; all other characters stand for themselves."""
    shapes = re.compile("|".join(f"({shape})" for shape, _ in tokens) + r"|[\s\S]")

    def one(m: re.Match) -> str:
        if m.lastindex is None:
            return re.escape(m[0])
        regex = tokens[m.lastindex - 1][1]
        return regex if isinstance(regex, str) else regex(m)

    return shapes.sub(one, pattern)


def fnmatch_regex(pattern: str) -> str:
    """``*`` and ``?`` cross slashes, ``[!x]`` and ``[^x]`` negate, an unterminated ``[`` is literal."""
    return f"(?s)^{_translate(pattern, [(r'\*+', '.*'), (r'\?', '.'), _set_token('!^')])}$"


def doublestar_regex(pattern: str) -> str:
    """``**`` between slashes spans any depth, none included; ``*`` and ``?`` stay in a segment; ``{a,b}`` chooses."""
    open_braces: list[int] = []

    def brace(m: re.Match) -> str:
        if m[0] == "{":
            open_braces.append(m.start())
            return "(?:"
        if not open_braces:
            return re.escape(m[0])
        if m[0] == ",":
            return "|"
        open_braces.pop()
        return ")"

    tokens: list[Token] = [
        (r"(?<![^/])\*\*/", "(?:[^/]*/)*"), (r"/\*\*\Z", "(?:/.*)?"), (r"\A\*\*\Z", ".*"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), _set_token("!^"),
        (r"[{},]", brace), (r"\\[\s\S]", lambda m: re.escape(m[0][1])),
    ]
    return f"(?s)^{_translate(pattern, tokens)}$"


def index_glob_regex(pattern: str) -> str:
    """Shell glob within one segment; ``dir/*`` also matches everything below ``dir/``."""
    out = _translate(pattern, [(r"\*", "[^/]*"), (r"\?", "[^/]"), _set_token("^")])
    return f"(?s)^(?:{out}|{re.escape(pattern[:-1])}.*)$" if pattern.endswith("/*") else f"(?s)^{out}$"


def any_of(regexes: list[str]) -> str:
    """One alternation; an empty list matches nothing."""
    return "|".join(f"(?:{r})" for r in regexes) if regexes else r"[^\s\S]"


def gitignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex, is negated) of ignore-file lines in order, comments and blanks left out.

    A pattern with a slash inside is anchored; without one it matches at any depth. A matched
    directory covers all below it. Negated directory patterns (``!dir/``) have no effect.
    """
    out = []
    for line in lines:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        folder = p.endswith("/")
        p = p.rstrip("/")
        if not p or (negated and folder):
            continue
        anchored = "/" in p
        body = doublestar_regex(p.lstrip("/"))[5:-1]
        head = "^" if anchored else "^(?:.*/)?"
        out.append((f"(?s){head}{body}{'/.*' if folder else '(?:/.*)?'}$", negated))
    return out
