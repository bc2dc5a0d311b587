"""One walk over the tokens of a Python text, so that lines and indentation alone tell its structure.

The walk keeps the bracket depth as a running count and, inside format strings,
a stack of modes: literal text, replacement field, format specification. Both
know no greatest depth.
"""

from __future__ import annotations

import re

MARK = "\x01"  # starts a line that goes on with the one before; no line of Python starts with it

_STRING = r"(?<!\w)(?P<prefix>[rbuft]{0,2})(?P<quote>'''|\"\"\"|'|\")"
_WORDS = r"\b(?:and|or)\b"
# Code at bracket depth 0, 1 and more. Each begins with a set of characters, which is what makes the search fast.
_CODE = [
    re.compile(r"""[#'"()\[\]{}]|\\\n"""),
    re.compile(r"""[#'"()\[\]{}\n]|\\\n"""),
    re.compile(rf"""[#'"()\[\]{{}}\n]|\\\n|[ao](?:(?<=\b.)(?:(?<=a)nd|(?<=o)r)\b)""", re.I),
]
_FIELD = re.compile(rf"#[^\n]*+|{_STRING}|[()\[\]{{}}:]|{_WORDS}", re.I)
_BLANKS = re.compile(r"[ \t]*+")
_PLAIN = {
    "'''": re.compile(r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"),
    '"""': re.compile(r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'),
    "'": re.compile(r"'(?:[^'\\\n]++|\\[\s\S])*+'"),
    '"': re.compile(r'"(?:[^"\\\n]++|\\[\s\S])*+"'),
}
# Within a format string: an escape, doubled braces, a field, the end. A backslash does not escape a brace.
_LITERAL = {
    (quote, raw): re.compile(("" if raw else r"\\N\{[^}]*+\}|") + r"\\[^{}]|\{\{|\}\}|\{|" + quote)
    for quote in _PLAIN for raw in (False, True)
}
_SPEC = re.compile(r"[{}]")


def _end_of_plain(text: str, at: int, quote: str) -> int:
    """Behind the string whose opening quote is at `at`."""
    found = _PLAIN[quote].match(text, at)
    return found.end() if found else len(text)


def _string_start(text: str, at: int, quote: int) -> int:
    """Where the string whose opening quote is at `quote` starts, not before `at`; -1 if a word runs into it."""
    start = quote
    while start > at and quote - start < 2 and text[start - 1] in "rbuftRBUFT":
        start -= 1
    return -1 if start and (text[start - 1].isalnum() or text[start - 1] == "_") else start


def _is_format(prefix: str) -> bool:
    return "f" in prefix.lower() or "t" in prefix.lower()


def _format_string(text: str, at: int, quote: str, raw: bool) -> tuple[int, list[str]]:
    """Behind the format string whose text starts at `at`, and the `and` / `or` of its fields, however nested."""
    stack: list[tuple] = [("text", quote, raw)]
    words: list[str] = []
    while stack:
        kind = stack[-1][0]
        pattern = _LITERAL[stack[-1][1:]] if kind == "text" else _SPEC if kind == "spec" else _FIELD
        found = pattern.search(text, at)
        if found is None:
            return len(text), words
        token, at = found[0], found.end()
        if kind == "text":
            if token == stack[-1][1]:
                stack.pop()
            elif token == "{":
                stack.append(("field", 0))
        elif kind == "spec":
            if token == "{":
                stack.append(("field", 0))
            else:
                stack.pop()
        elif token[0] == "#":
            continue
        elif found["quote"]:
            if _is_format(found["prefix"]):
                stack.append(("text", found["quote"], "r" in found["prefix"].lower()))
            else:
                at = _end_of_plain(text, found.start("quote"), found["quote"])
        elif token in "([{":
            stack[-1] = ("field", stack[-1][1] + 1)
        elif token in ")]}":
            if stack[-1][1]:
                stack[-1] = ("field", stack[-1][1] - 1)
            else:
                stack.pop()
        elif token == ":":
            if not stack[-1][1]:
                stack[-1] = ("spec",)
        elif token.islower():
            words.append(token)
    return at, words


def masked_text(text: str) -> str:
    """The text without comments and contents of strings, its lines in place.

    A string becomes an empty one, a format string one followed by the `and` /
    `or` of its fields. Line ends inside strings, inside brackets and behind a
    backslash are kept, but what follows starts with MARK. Within brackets in
    brackets only `and` / `or` and line ends stay, so no bracket is in another.
    """
    out: list[str] = []
    at = seek = depth = 0
    while found := _CODE[min(depth, 2)].search(text, seek):
        start, token = found.start(), found[0]
        shallow = depth <= 1
        end = found.end()
        if token in "'\"":
            start = _string_start(text, at, start)
            if start < 0:
                seek = end
                continue
        if shallow:
            out.append(text[at:start])
        if token in "'\"":
            prefix, quote = text[start:end - 1], text[end - 1:end + 2]
            quote = quote if quote == 3 * token else token
            words: list[str] = []
            if _is_format(prefix):
                end, words = _format_string(text, end - 1 + len(quote), quote, "r" in prefix.lower())
            else:
                end = _end_of_plain(text, end - 1, quote)
            out.append("''" * shallow + f"\n{MARK}''" * text.count("\n", start, end))
            out.extend(f" {word} " for word in words)
        elif token == "#":
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        elif token in "([{":
            if not depth:
                out.append(token)
            depth += 1
        elif token in ")]}":
            depth = max(0, depth - 1)
            if not depth:
                out.append(token)
        elif token[-1] == "\n":
            end = _BLANKS.match(text, end).end()
            out.append(token[:-1] * shallow + f"\n{MARK}_ ")
        else:
            out.append(f" {token} ")
        at = seek = end
    if depth <= 1:
        out.append(text[at:])
    return "".join(out)
