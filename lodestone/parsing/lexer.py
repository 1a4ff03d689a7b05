"""A lexer for brace languages: strings, comments and preprocessor lines are recognised, so that braces in them don't count."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Token:
    kind: str  # word, text (string or other literal), op, pp (preprocessor line)
    text: str
    start: int
    end: int
    line_start: bool = False
    match: int = -1  # index of the matching bracket token


@dataclass
class Source:
    raw: bytes
    tokens: list[Token] = field(default_factory=list)
    line_starts: list[int] = field(default_factory=list)


_COMMENT = {"c": rb"//[^\n]*|/\*.*?(?:\*/|\Z)", "php": rb"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)"}
_WORD = rb"(?P<word>[A-Za-z_$\x80-\xff~][\w$\x80-\xff]*)|(?P<number>\d[\w.]*)"
_PLAIN = rb"\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)"
_CHAR = rb"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
_STRINGS = {
    "c": rb"R\"(?P<d>[^()\s\\]{0,16})\(.*?\)(?P=d)\"|" + _PLAIN + rb"|" + _CHAR,
    "csharp": rb"\"\"\".*?(?:\"\"\"|\Z)|[$]?@[$]?\"(?:[^\"]|\"\")*(?:\"|\Z)|" + _PLAIN + rb"|" + _CHAR,
    "go": rb"`[^`]*(?:`|\Z)|" + _PLAIN + rb"|" + _CHAR,
    "java": rb"\"\"\".*?(?:\"\"\"|\Z)|" + _PLAIN + rb"|" + _CHAR,
    "javascript": _PLAIN + rb"|" + _CHAR,
    "php": rb"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|<<<[\"']?(?P<doc>\w+)[\"']?\n.*?\n\s*(?P=doc)\b",
    "rust": rb"b?r(?P<h>#*)\".*?\"(?P=h)|b?" + rb"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|b?'(?:[^'\\\n]|\\[^\n]+?)'|'[A-Za-z_]\w*",
}
_OPS = rb"(?P<op>=>|->|::|\?->|<<<|[-+*/%&|^!=<>?:.,;@#\\(){}\[\]])"
_FAMILY = {"c": "c", "cpp": "c", "tsx": "javascript", "typescript": "javascript"}
#: Tokens after which a slash starts a regular expression, not a division. Fixed values.
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "<", ">", "=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new"}
_REGEX = re.compile(rb"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def _pattern(language: str) -> re.Pattern:
    family = _FAMILY.get(language, language)
    comment = _COMMENT["php" if family == "php" else "c"]
    start = rb"(?P<pp>#(?:[^\n\\/]|/(?![*/])|\\\r?\n|\\.)*)|" if family == "c" else b""
    return re.compile(rb"(?P<space>\s+)|" + start + rb"(?P<comment>" + comment + rb")|(?P<text>" + _STRINGS[family] + rb")|" + _WORD + rb"|" + _OPS + rb"|(?P<other>.)", re.S)


_PATTERNS: dict[str, re.Pattern] = {}


def _template_end(raw: bytes, at: int) -> int:
    """The end of a template literal that starts at `at`, nested expressions included."""
    i, depth = at + 1, []
    while i < len(raw):
        c = raw[i : i + 1]
        if c == b"\\":
            i += 2
            continue
        if not depth or depth[-1] == "`":
            if c == b"`":
                if not depth:
                    return i + 1
                depth.pop()
            elif raw[i : i + 2] == b"${":
                depth.append("{")
                i += 2
                continue
        elif c == b"{":
            depth.append("{")
        elif c == b"}":
            depth.pop()
        elif c == b"`":
            depth.append("`")
        i += 1
    return len(raw)


def lex(raw: bytes, language: str) -> Source:
    pattern = _PATTERNS.setdefault(language, _pattern(language))
    scripted = _FAMILY.get(language, language) == "javascript"
    src = Source(raw, [], [0, *(m.end() for m in re.finditer(rb"\n", raw))])
    tokens, at, new_line = src.tokens, 0, True
    if language == "php":
        m = re.search(rb"<\?(?:php|=)?", raw)
        at = m.end() if m else len(raw)
    while at < len(raw):
        if scripted and raw[at] == 0x60:
            end = _template_end(raw, at)
            tokens.append(Token("text", "`", at, end, new_line))
            at, new_line = end, False
            continue
        if scripted and raw[at] == 0x2F and (not tokens or tokens[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(raw, at)):
            tokens.append(Token("text", "/", at, m.end(), new_line))
            at, new_line = m.end(), False
            continue
        if language == "php" and raw[at : at + 2] == b"?>":
            m = re.compile(rb"<\?(?:php|=)?").search(raw, at)
            at = m.end() if m else len(raw)
            continue
        m = pattern.match(raw, at)
        kind = m.lastgroup
        at = m.end()
        if kind in ("d", "doc", "h"):
            kind = "text"
        if kind == "space":
            new_line |= b"\n" in m[0]
            continue
        if kind == "comment":
            continue
        kind = {"number": "text", "other": "op"}.get(kind, kind)
        text = m[0].decode("utf-8", "replace") if kind in ("word", "op", "pp") else ""
        tokens.append(Token(kind, text.rstrip() if kind == "pp" else text, m.start(), m.start() + len(m[0].rstrip()) if kind == "pp" else m.end(), new_line))
        new_line = False
    _pair(tokens)
    return src


def _pair(tokens: list[Token]) -> None:
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            # a closing bracket drops what was opened inside and never closed
            for k in range(len(stack) - 1, -1, -1):
                if tokens[stack[k]].text == _CLOSE[t.text]:
                    tokens[stack[k]].match, t.match = i, stack[k]
                    del stack[k:]
                    break
