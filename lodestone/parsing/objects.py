"""Structural objects of source files: a file object, then one for each definition, in order of their places.

Python is read with its own syntax tree, and by its lines where that fails; Ruby by its block words; the brace
languages by declaration shapes over the lexer's tokens. A definition's context is the first row of each named
ancestor that starts above it, and the last row of each that ends below it."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass

from lodestone.functions.text import LANGUAGES
from lodestone.parsing.lexer import Source, Token, lex


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    scope: bool = True  # whether it is a named ancestor of what lies inside
    reported: bool = True


def decode(raw: bytes) -> str:
    for encoding in ("utf-8", "windows-1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("iso-8859-1")


def language_of(path: str) -> str | None:
    stem, dot, suffix = path.rpartition("/")[2].rpartition(".")
    return LANGUAGES.get(suffix) if dot and stem else None


# ---- brace languages


class Reader:
    """Finds declarations among the tokens of a source."""

    def __init__(self, src: Source, language: str):
        self.src, self.t, self.language, self.out = src, src.tokens, language, []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def add(self, name, kind, first: int, last: int, **more):
        if 0 <= first < len(self.t) and first <= last:
            last = min(last, len(self.t) - 1)
            self.out.append(Definition(name, kind, self.t[first].start, self.t[last].end, **more))

    def skip(self, i: int, *stops: str) -> int:
        """The first token from i on that is one of the stops, brackets jumped over; len(tokens) without one."""
        while i < len(self.t):
            if self.t[i].kind == "op" and self.t[i].text in stops:
                return i
            i = self.t[i].match + 1 if self.text(i) in "([{" and self.t[i].kind == "op" and self.t[i].match > i else i + 1
        return i

    def close(self, i: int) -> int:
        return self.t[i].match if 0 <= i < len(self.t) and self.t[i].match > i else len(self.t) - 1

    def first_of_statement(self, i: int, over: frozenset = frozenset(), brackets: bool = False) -> int:
        """Back over words of `over` (modifiers), and bracketed annotations or attributes."""
        while i > 0:
            if self.is_word(i - 1) and self.text(i - 1) in over:
                i -= 1
            elif brackets and self.text(i - 1) == "]" and 0 <= self.t[i - 1].match < i:
                i = self.t[i - 1].match
            elif brackets and self.is_word(i - 1) and self.text(i - 2) == "@":
                i -= 2
            elif brackets and self.text(i - 1) == ")" and self.text(self.t[i - 1].match - 2) == "@":
                i = self.t[i - 1].match - 2
            else:
                break
        return i


MODIFIERS = frozenset("public private protected internal static final abstract sealed partial async override virtual readonly extern unsafe new native synchronized strictfp default transient volatile const var".split())
CONTROL = frozenset("if for while switch catch return else do try foreach using lock fixed sizeof typeof new await throw case when synchronized match fn function elseif unless and or not in is as echo print isset empty assert yield delete".split())


def _types(r: Reader, kinds: dict[str, str], modifiers=MODIFIERS, brackets=True) -> None:
    """`keyword Name ... { }` declarations."""
    for i, t in enumerate(r.t):
        if t.kind == "word" and t.text in kinds and r.is_word(i + 1) and r.text(i - 1) not in (".", "::", "->"):
            body = r.skip(i + 2, "{", ";", ")", "=")
            if r.text(body) == "{":
                r.add(r.text(i + 1), kinds[t.text], r.first_of_statement(i, modifiers, brackets), r.close(body))


def _bodies(r: Reader, owners: tuple[str, ...]) -> list[tuple[int, int]]:
    """Token ranges of the bodies of type declarations with one of the keywords."""
    out = []
    for i, t in enumerate(r.t):
        if t.kind == "word" and t.text in owners and r.is_word(i + 1):
            body = r.skip(i + 2, "{", ";", ")")
            if r.text(body) == "{":
                out.append((body, r.close(body)))
    return out


def _members(r: Reader, bodies, kind: str, ends: str = ";", constructors: bool = False) -> None:
    """Methods: `Type name(...) ... {` or `;` directly inside type bodies."""
    for lo, hi in bodies:
        i = lo + 1
        while i < hi:
            at = r.skip(i, "{", ";", "(", "=", "}")
            if at >= hi:
                break
            if r.text(at) == "(":
                name = at - 1
                generic = r.text(name) == ">"
                if r.is_word(name) and not generic and r.text(name) not in CONTROL and name > i - 1 and r.text(name - 1) != "@":
                    typed = name > i and (r.is_word(name - 1) and r.text(name - 1) not in MODIFIERS - {"var"} | {"new"} or r.text(name - 1) in (">", "]", "?", "*", "&"))
                    after = r.skip(r.close(at) + 1, "{", ";", "=", "=>")
                    end = r.close(after) if r.text(after) == "{" else r.skip(after, ";")
                    if typed or constructors:
                        r.add(r.text(name), kind, i, end)
                    i = end + 1
                    continue
                i = r.close(at) + 1 if r.text(at - 2) == "@" or r.text(at - 1) == "@" else at + 1
                if r.text(at - 2) == "@":  # an annotation with arguments belongs to what follows
                    start = at - 2
                    j = r.close(at) + 1
                    at2 = r.skip(j, "{", ";", "(", "=")
                    if r.text(at2) == "(" and r.is_word(at2 - 1):
                        after = r.skip(r.close(at2) + 1, "{", ";")
                        end = r.close(after) if r.text(after) == "{" else after
                        r.add(r.text(at2 - 1), kind, start, end)
                        i = end + 1
                continue
            i = (r.close(at) if r.text(at) == "{" else at) + 1


def java(r: Reader) -> None:
    _types(r, {"class": "definition.class", "interface": "definition.interface"})
    for i, t in enumerate(r.t):  # other named ancestors
        if t.text in ("enum", "record") and t.kind == "word" and r.is_word(i + 1) and r.text(body := r.skip(i + 2, "{", ";")) == "{":
            r.add(r.text(i + 1), "", r.first_of_statement(i, MODIFIERS, True), r.close(body), reported=False)
    _members(r, _bodies(r, ("class", "interface", "enum", "record")), "definition.method")


def csharp(r: Reader) -> None:
    _types(r, {"class": "definition.class", "interface": "definition.interface"})
    for i, t in enumerate(r.t):
        if t.kind != "word":
            continue
        if t.text == "namespace" and r.is_word(i + 1):
            body = r.skip(i + 1, "{", ";")
            dotted = r.text(i + 2) == "."
            if r.text(body) == "{":
                r.add(r.text(i + 1), "definition.module", i, r.close(body), reported=not dotted)
        elif t.text in ("struct", "record", "enum") and r.is_word(i + 1) and r.text(body := r.skip(i + 2, "{", ";")) == "{":
            r.add(r.text(i + 1), "", r.first_of_statement(i, MODIFIERS, True), r.close(body), reported=False)
    _members(r, _bodies(r, ("class", "interface", "struct", "record")), "definition.method")


def php(r: Reader) -> None:
    _types(r, {"class": "definition.class", "interface": "definition.interface", "trait": "definition.interface"}, brackets=False)
    bodies = _bodies(r, ("class", "interface", "trait", "enum"))
    for i, t in enumerate(r.t):
        if t.kind != "word":
            continue
        if t.text == "namespace" and r.is_word(i + 1):
            end = r.skip(i + 1, "{", ";")
            name = "".join(x.text for x in r.t[i + 1 : end])
            r.add(name, "definition.module", i, r.close(end) if r.text(end) == "{" else end)
        elif t.text == "implements" or t.text == "extends" and r.text(i - 2) == "interface":
            end = r.skip(i + 1, "{")
            if t.text == "implements":
                j = i + 1
                while j < end:
                    stop = j
                    while stop < end and r.text(stop) != ",":
                        stop += 1
                    r.add("".join(x.text for x in r.t[j:stop]), "definition.class_interface_clause", i, end - 1, scope=False)
                    j = stop + 1
        elif t.text == "function" and r.is_word(i + (2 if r.text(i + 1) == "&" else 1)):
            name = i + (2 if r.text(i + 1) == "&" else 1)
            after = r.skip(r.close(name + 1) + 1, "{", ";") if r.text(name + 1) == "(" else len(r.t)
            end = r.close(after) if r.text(after) == "{" else after
            inside = any(lo < i < hi for lo, hi in bodies) and not any(d.kind in ("definition.method", "definition.function") and d.start < t.start < d.end for d in r.out)
            r.add(r.text(name), "definition.method" if inside else "definition.function", r.first_of_statement(i, MODIFIERS), end)
        elif t.text.startswith("$") and len(t.text) > 1 and any(lo < i < hi for lo, hi in bodies):
            # a property: modifiers and a type stand before it, directly in the body
            j = i
            while j > 0 and (r.is_word(j - 1) or r.text(j - 1) in ("?", "|", "\\")) and not r.text(j - 1).startswith("$"):
                j -= 1
            if j < i and r.text(j) in MODIFIERS and r.text(j - 1) in ("{", "}", ";", "]"):
                r.add(t.text[1:], "definition.field", j, r.skip(i, ";"), scope=False)


RUST = {"struct": "definition.struct", "enum": "definition.class", "union": "definition.class", "type": "definition.class", "fn": "definition.function", "trait": "definition.interface", "mod": "definition.module"}


def rust(r: Reader) -> None:
    t = r.t
    for i, x in enumerate(t):
        if x.kind != "word":
            continue
        if x.text in RUST and r.is_word(i + 1) and r.text(i + 1) not in RUST:
            stop = r.skip(i + 2, "{", ";", "=", "}") if x.text != "type" else r.skip(i + 2, ";")
            if x.text == "union" and r.text(stop) != "{":
                continue
            if x.text == "fn" and r.text(stop) == ";":
                continue  # a signature, not a function with a body
            end = r.close(stop) if r.text(stop) == "{" else r.skip(stop, ";")
            r.add(r.text(i + 1), RUST[x.text], _rust_first(r, i), end)
        elif x.text == "macro_rules" and r.text(i + 1) == "!" and r.is_word(i + 2):
            body = r.skip(i + 3, "{", "(", "[")
            r.add(r.text(i + 2), "definition.macro", i, r.close(body))
        elif x.text == "impl" and (x.line_start or r.text(i - 1) in ("unsafe", "}", ";", "]", "{")):
            body = r.skip(i + 1, "{", ";")
            j = i + 1
            if r.text(j) == "<":
                depth = 0
                while j < body:
                    depth += (r.text(j) == "<") - (r.text(j) == ">")
                    j += 1
                    if not depth:
                        break
            split = next((k for k in range(j, body) if r.text(k) == "for" and r.is_word(k)), -1)
            # only plain names count; generic and path types keep the scope without a row of their own
            plain = r.is_word(j) and (split == j + 1 if split >= 0 else r.text(j + 1) in ("{", "where"))
            kind = "definition.trait.impl" if split >= 0 else "definition.struct.impl"
            r.add(r.text(j), kind, _rust_first(r, i), r.close(body), reported=plain)


def _rust_first(r: Reader, i: int) -> int:
    while i > 0:
        if r.is_word(i - 1) and r.text(i - 1) in ("pub", "unsafe", "async", "const", "extern", "default") or r.text(i - 1) == "" and r.text(i - 2) == "extern":
            i -= 1
        elif r.text(i - 1) == ")" and r.text(r.t[i - 1].match - 1) == "pub":
            i = r.t[i - 1].match - 1
        else:
            break
    return i


def go(r: Reader) -> None:
    for i, x in enumerate(r.t):
        if x.kind != "word":
            continue
        if x.text == "func" and (r.is_word(i + 1) or r.text(i + 1) == "(" and x.line_start):
            name = i + 1 if r.is_word(i + 1) else r.close(i + 1) + 1
            if not r.is_word(name):
                continue
            params = name + 1
            if r.text(params) == "[":
                params = r.close(params) + 1
            j = r.close(params) + 1
            while j < len(r.t) and r.text(j) != "{" and not r.t[j].line_start:
                if r.text(j) in ("struct", "interface") and r.text(j + 1) == "{":
                    j = r.close(j + 1) + 1
                else:
                    j = r.close(j) + 1 if r.text(j) in ("(", "[") else j + 1
            r.add(r.text(name), "definition.function" if name == i + 1 else "definition.method", i, r.close(j) if r.text(j) == "{" else j - 1)
        elif x.text == "type" and x.line_start:
            group = r.text(i + 1) == "("
            last = r.close(i + 1) if group else -1
            j = i + 2 if group else i + 1
            while r.is_word(j) and (not group or j < last):
                end = j + 1
                while end < len(r.t) and not (r.t[end].line_start and end > j + 1) and (not group or end < last):
                    end = r.close(end) + 1 if r.text(end) in ("{", "(", "[") and r.t[end].match > end else end + 1
                r.add(r.text(j), "definition.type", i, last if group else end - 1, scope=False)
                if not group:
                    break
                j = end


def c_family(r: Reader) -> None:
    t = r.t
    opened: list[tuple[int, str]] = []
    for i, x in enumerate(t):  # conditional blocks are named ancestors where they name a macro
        if x.kind == "pp":
            m = re.match(r"#\s*(ifdef|ifndef|if|endif)\b\s*(\w*)", x.text)
            if m and m[1] == "endif":
                if opened:
                    first, name = opened.pop()
                    r.add(name, "", first, i, reported=False, scope=bool(name))
            elif m:
                opened.append((i, m[2] if m[1] != "if" else ""))
    types = []
    for i, x in enumerate(t):
        if x.kind == "word" and x.text == "namespace" and r.language == "cpp" and r.text(body := r.skip(i + 1, "{", ";", "=")) == "{":
            r.add(r.text(i + 1), "", i, r.close(body), reported=False, scope=r.is_word(i + 1))
        if x.kind != "word" or x.text not in ("struct", "class", "union", "enum") or r.text(i - 1) in ("<", ",", "enum") and r.text(i - 1) != ",":
            continue
        j = i + 1
        if x.text == "enum" and r.text(j) in ("class", "struct"):
            j += 1
        named = r.is_word(j) and r.text(j) not in ("final",)
        stop = r.skip(j + named, "{", ";", "(", ")", ",", "=", "*", ">", "&")
        if r.text(stop) == "{":
            types.append((i, j if named else -1, stop, r.close(stop)))
            if named and not (x.text in ("class",) and r.language == "c"):
                kind = {"struct": "definition.struct", "class": "definition.class", "enum": "definition.type"}.get(x.text)
                if kind:
                    r.add(r.text(j), kind, i, r.close(stop))
                else:  # a union: reported where a variable is declared with it
                    after = r.close(stop) + 1
                    if r.is_word(after) and r.text(i - 1) != "typedef":
                        r.add(r.text(j), "definition.class", i, r.skip(after, ";"))
                    r.add(r.text(j), "", i, r.close(stop), reported=False)
        elif named and x.text == "union" and r.is_word(stop - 1) and stop - 1 > j and r.text(stop) in (";", "=", ",") and r.text(i - 1) != "typedef":
            r.add(r.text(j), "definition.class", i, r.skip(stop, ";"))
        elif named and x.text == "enum" and r.text(i - 1) != "typedef":
            r.add(r.text(j), "definition.type", i, j, scope=False)
        elif named and x.text == "class" and r.language == "cpp" and r.text(stop) == ";":
            r.add(r.text(j), "definition.class", i, j, scope=False)
    for i, x in enumerate(t):
        if x.kind == "word" and x.text == "typedef":
            end = r.skip(i + 1, ";")
            if end < len(t) and r.is_word(end - 1):
                r.add(r.text(end - 1), "definition.type", i, end, scope=False)
    # functions: name(...) before a brace; in-class declarations: name(...) before a semicolon
    inside = [(a, b, r.text(n) if n >= 0 else "") for _, n, a, b in types if _ is not None]
    for i, x in enumerate(t):
        if x.text != "(" or x.kind != "op" or not r.is_word(i - 1) or r.text(i - 1) in CONTROL or x.match < 0:
            continue
        name = i - 1
        first = _c_first(r, name)
        if first == name or r.text(first) in ("return", "else", "case", "typedef", "throw", "new", "using", "#"):
            continue
        owner = next(((a, b, n) for a, b, n in reversed(inside) if a < i < b), None)
        j = x.match + 1
        while r.is_word(j) or r.text(j) in ("&", "->", "::", "<", ">", "*"):
            j += 1
        if r.text(j) == "=" and r.text(j + 2) == ";":  # pure virtual, defaulted
            j += 2
        elif r.text(j) == ":":
            j = r.skip(j, "{", ";")
        qualified = r.text(name - 1) == "::"
        # a constructor, destructor or conversion has no type before its name
        typed = name - 1 >= first and not (qualified and name - 2 == first)
        if r.text(j) == "{" and not _in_function(r, i):
            if qualified and r.language == "cpp":
                if r.text(name - 3) != "::":
                    r.add(r.text(name), "definition.method", first, r.close(j))
            elif typed and r.text(name - 1) not in ("*", "&") or typed:
                pointer = r.text(name - 1) in ("*", "&")
                if owner is None and not pointer:
                    r.add(r.text(name), "definition.function", first, r.close(j), scope=False)
        elif r.text(j) == ";" and owner and r.language == "cpp" and typed and not r.text(name).startswith("~") and r.text(name) != owner[2] and not _in_function(r, i) and r.text(name - 1) not in ("*", "&", ".", "->", "=", ",", "(", ")"):
            r.add(r.text(name), "definition.method", first, j, scope=False)


def _c_first(r: Reader, name: int) -> int:
    i = name
    while i > 0:
        p = r.t[i - 1]
        if p.kind == "pp" or p.text in (";", "{", "}", ":", ")", "(", ",", "=") and not (p.text == ":" and False):
            break
        i -= 1
    return i


def _in_function(r: Reader, i: int) -> bool:
    """Whether token i is inside a body that follows a parameter list."""
    inside = r.__dict__.get("_fn")
    if inside is None:
        inside, until = [], -1
        for k, x in enumerate(r.t):
            inside.append(k < until)
            if x.text == "{" and x.match > k and (r.text(k - 1) == ")" or r.is_word(k - 1) and r.text(k - 1) in ("const", "override", "noexcept", "final") and ")" in (r.text(k - 2), r.text(k - 3))):
                until = max(until, x.match)
        r.__dict__["_fn"] = inside
    return inside[i]


def javascript(r: Reader) -> None:
    t, typed = r.t, r.language != "javascript"
    inner = _innermost(r, "([{")
    block, top = _innermost(r, "{"), [a < 0 for a in inner]
    blocks = [(i, x.match) for i, x in enumerate(t) if x.text == "{" and x.kind == "op" and x.match > i]

    def arrow(i: int) -> int:
        """Index of the body's first token if an arrow or function expression starts at i, else -1."""
        if r.text(i) == "async" and not t[i].line_start:
            i += 1
        if r.text(i) == "function":
            body = r.skip(i + 1, "{", ";")
            return body if r.text(body) == "{" else -1
        j = i
        if r.text(j) == "<":
            while j < len(t) and r.text(j) != "(":
                j += 1
        if r.text(j) == "(":
            j = r.close(j) + 1
            if typed and r.text(j) == ":":
                j = r.skip(j + 1, "=>", ";", ",")
            return j + 1 if r.text(j) == "=>" else -1
        return j + 2 if r.is_word(j) and r.text(j + 1) == "=>" else -1

    def value_end(i: int) -> int:
        """The last token of the statement that goes on at i; line ends count where no operator goes on."""
        while i < len(t):
            if t[i].text == ";" and t[i].kind == "op":
                return i
            if t[i].text in "([{" and t[i].kind == "op" and t[i].match > i:
                i = t[i].match
            elif t[i].text in ")]}" and t[i].kind == "op":
                return i - 1
            if i + 1 >= len(t):
                return i
            n = t[i + 1]
            goes_on = n.text in (".", "?", ":", "+", "-", "*", "/", "&", "|", "=", "=>", ",", "<", ">", ")", "]", "(", "[") or t[i].text in ("=", "+", "-", "*", "/", "&", "|", "?", ":", ",", ".", "=>", "(", "[", "{", "<", "!")
            if n.line_start and not goes_on:
                return i
            i += 1
        return len(t) - 1

    def expression_end(i: int) -> int:
        body = arrow(i)
        if body >= 0 and r.text(body) == "{":
            return r.close(body)
        j = i
        while j < len(t) and not (t[j].kind == "op" and t[j].text in (",", ";", ")", "}", "]")):
            j = r.close(j) + 1 if t[j].text in "([{" and t[j].kind == "op" and t[j].match > j else j + 1
            if j < len(t) and t[j].line_start and t[j].text not in (".", "?", ":", "+", "-", "*", "&", "|", "=>"):
                break
        return j - 1

    for i, x in enumerate(t):
        before = r.text(i - 1)
        if x.kind == "word" and before not in (".", "?."):
            if x.text in ("const", "let", "var"):
                first, j, end = i, i + 1, value_end(i)
                exported = before == "export"
                while r.is_word(j):
                    name, k = j, j + 1
                    if typed and r.text(k) in (":", "!"):
                        k = r.skip(k, "=", ";", ",")
                    if r.text(k) != "=":
                        break
                    value = k + 1
                    if arrow(value) >= 0:
                        r.add(r.text(name), "definition.function", name, expression_end(value))
                    elif top[i]:
                        r.add(r.text(name), "definition.constant", first - exported, end, scope=False)
                    stop = value
                    while stop <= end and not (t[stop].text == "," and t[stop].kind == "op"):
                        stop = r.close(stop) + 1 if t[stop].text in "([{" and t[stop].kind == "op" and t[stop].match > stop else stop + 1
                    if stop > end:
                        break
                    j = stop + 1
            elif x.text == "function":
                j = i + 1 + (r.text(i + 1) == "*")
                if r.is_word(j):
                    body = r.skip(j + 1, "{", ";")
                    first = i - (before == "async")
                    if r.text(body) == "{":
                        r.add(r.text(j), "definition.function", first, r.close(body))
                    elif typed:
                        r.add(r.text(j), "definition.function", first, min(body, len(t) - 1))
            elif x.text == "class" and r.is_word(i + 1) and r.text(i + 1) not in ("extends", "implements"):
                body = r.skip(i + 2, "{")
                first = i - (before == "abstract")
                r.add(r.text(i + 1), "definition.class", first, r.close(body))
            elif typed and x.text == "interface" and r.is_word(i + 1) and r.text(body := r.skip(i + 2, "{", ";")) == "{":
                r.add(r.text(i + 1), "definition.interface", i, r.close(body))
            elif typed and x.text == "module" and r.is_word(i + 1) and r.text(i + 2) == "{":
                r.add(r.text(i + 1), "definition.module", i, r.close(i + 2))
            elif r.text(i + 1) == ":" and before in ("{", ",") and arrow(i + 2) >= 0:
                r.add(x.text, "definition.function", i, expression_end(i + 2))
        if x.text == "=" and x.kind == "op" and r.is_word(i - 1) and r.text(i + 1) not in ("=", ">") and arrow(i + 1) >= 0:
            j = i - 1
            while r.text(j - 1) == "." and r.is_word(j - 2):
                j -= 2
            if r.text(j - 1) not in ("const", "let", "var", ",", ":", "|", "&", "#") and not (block[i] >= 0 and _class_body(r, block[i])):
                r.add(r.text(i - 1), "definition.function", j, expression_end(i + 1), scope=False)
    for a, b in blocks:
        kind = _class_body(r, a)
        if not kind and not _object_literal(r, a):
            continue
        j = a + 1
        while j < b:
            k = r.skip(j, "(", ",", ";", "=", "{", "}", ":")
            if k >= b:
                break
            if r.text(k) == "(" and r.is_word(k - 1) and r.text(k - 1) not in CONTROL - {"delete", "in", "is", "as", "print", "match", "not", "and", "or"}:
                after = r.close(k) + 1
                if typed and r.text(after) == ":":
                    after = r.skip(after + 1, "{", ";", ",") if r.text(after + 1) != "{" else r.skip(r.close(after + 1) + 1, "{", ";", ",")
                first = k - 1
                while first > j and (r.is_word(first - 1) or r.text(first - 1) in ("*", "#")):
                    first -= 1
                if r.text(after) == "{":
                    r.add(r.text(k - 1), "definition.method", first, r.close(after))
                    j = r.close(after) + 1
                    continue
                if typed and kind:
                    r.add(r.text(k - 1), "definition.method", first, after - 1)
                j = after + 1
                continue
            if r.text(k) in ("=", ":"):
                j = k + 1
                while j < b and not (t[j].kind == "op" and t[j].text in (";", ",")) and not (kind and t[j].line_start and t[j - 1].text not in ("=", ":", "=>", "|", "&")):
                    j = r.close(j) + 1 if t[j].text in "([{" and t[j].kind == "op" and t[j].match > j else j + 1
                continue
            j = (r.close(k) if r.text(k) in "({" and t[k].match > k else k) + 1


def _innermost(r: Reader, kinds: str) -> list[int]:
    """For each token the closed bracket of one of the kinds that opens last around it, or -1."""
    out, open_ = [], []
    for i, x in enumerate(r.t):
        while open_ and r.t[open_[-1]].match <= i:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        if x.kind == "op" and x.text in kinds and x.match > i:
            open_.append(i)
    return out


def _class_body(r: Reader, brace: int) -> str:
    """The keyword of the class or interface whose body opens at the brace, or nothing."""
    j = brace - 1
    while j >= 0 and (r.t[j].kind == "word" and r.text(j) not in ("class", "interface") or r.text(j) in (",", ".", "<", ">", "|", "&", "[", "]")):
        j -= 1
    if j < 0 or r.t[j].kind != "word":
        return ""
    return r.text(j)


def _object_literal(r: Reader, brace: int) -> bool:
    return r.text(brace - 1) in ("=", "(", ",", ":", "[", "return", "?")


# ---- Python and Ruby


def python(raw: bytes) -> list[Definition]:
    text = decode(raw)
    starts = [0, *(m.end() for m in re.finditer(rb"\n", raw))]
    try:
        tree = ast.parse(raw if text.encode("utf-8") == raw else text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(raw, starts)
    out = []
    size = len(raw)
    place = lambda line, col: min(starts[min(line, len(starts)) - 1] + col, size)

    def walk(node, top):
        for child in ast.iter_child_nodes(node):
            name = kind = None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name, kind = child.name, "definition.function"
            elif isinstance(child, ast.ClassDef):
                name, kind = child.name, "definition.class"
            elif top and isinstance(child, ast.Assign):
                for target in child.targets:
                    if isinstance(target, ast.Name):
                        begin, scope = target, False
                        out.append(Definition(target.id, "definition.constant", place(begin.lineno, begin.col_offset), place(child.end_lineno, child.end_col_offset), scope))
                        break
            elif top and isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name):
                out.append(Definition(child.target.id, "definition.constant", place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), False))
            if name:
                out.append(Definition(name, kind, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
            walk(child, False)

    walk(tree, True)
    return out


def _python_lines(raw: bytes, starts: list[int]) -> list[Definition]:
    """Definitions by their indentation, for files that don't parse."""
    lines = raw.split(b"\n")
    out = []
    for i, line in enumerate(lines):
        if m := re.match(rb"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)", line):
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]) and not lines[j].lstrip().startswith((b")", b"]", b"}", b"#")):
                    break
                if lines[j].strip():
                    end = j
            kind = "definition.class" if m[2] == b"class" else "definition.function"
            out.append(Definition(decode(m[3]), kind, starts[i] + len(m[1]), starts[end] + len(lines[end].rstrip())))
        elif m := re.match(rb"([^\W\d]\w*)[ \t]*(?::[^=]+)?=(?!=)", line):
            out.append(Definition(decode(m[1]), "definition.constant", starts[i], starts[i] + len(line.rstrip()), False))
    return out


_RUBY = re.compile(rb"(?P<skip>^=begin\b.*?^=end\b[^\n]*|#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|:\"(?:[^\"\\]|\\.)*\"|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})|:[A-Za-z_]\w*[?!=]?|\.\s*[A-Za-z_]\w*[?!]?|\b[A-Za-z_]\w*[?!]?:(?!:)|\n\s*\n)|(?P<word>\b[A-Za-z_]\w*[?!=]?(?!\w))|(?P<line>[\n;])", re.M | re.S)
_NAME = rb"((?:self|[A-Za-z_]\w*)\s*\.\s*)?([A-Za-z_\x80-\xff][\w\x80-\xff]*[?!=]?|\[\]=?|[-+*/%<>=!~^&|]+)"


def ruby(raw: bytes) -> list[Definition]:
    out: list[Definition] = []
    stack: list[Definition | None] = []
    fresh, loop = True, False  # whether a statement starts here; whether a `do` belongs to a loop word before it
    at = 0
    while m := _RUBY.search(raw, at):
        gap = raw[at : m.start()].strip()
        at = m.end()
        if gap:
            fresh = gap[-1:] in (b"=", b"(", b"|", b"{", b"&", b",", b"[")
        if m["skip"] is not None:
            fresh = b"\n" in m["skip"] or m["skip"].startswith(b"#") and fresh
            continue
        if m["line"]:
            fresh, loop = True, False
            continue
        w = m["word"]
        if w == b"end":
            if stack and (d := stack.pop()):
                d.end = m.end()
        elif w in (b"class", b"module") and fresh:
            k = re.compile(rb"\s+((?:[A-Z]\w*::)*)([A-Z]\w*)|\s*<<\s*(?:(?:[A-Z]\w*::)*([A-Z]\w*)|(\w+))").match(raw, at)
            d = Definition("", "definition." + w.decode(), m.start(), len(raw))
            if k:
                d.name = decode(k[2] or k[3] or k[4])
                # `class << self` has no constant to name it
                d.reported, d.scope = k[4] is None, k[2] is not None
                at = k.end()
                out.append(d)
            stack.append(d)
        elif w == b"def":
            k = re.compile(rb"\s+" + _NAME).match(raw, at)
            d = Definition(decode(k[2]) if k else "", "definition.method", m.start(), len(raw))
            if k:
                out.append(d)
                at = k.end()
                tail = re.compile(rb"[ \t]*(?:\([^)]*\))?[ \t]*=(?![=~>])[ \t]*[^\n]*").match(raw, at)
                if tail:  # an endless method
                    d.end = at = tail.end()
                    continue
            stack.append(d)
        elif w == b"alias":
            if k := re.compile(rb"[ \t]+:?([\w?!=$]+)[ \t]+:?[\w?!=$]+").match(raw, at):
                out.append(Definition(decode(k[1]), "definition.method", m.start(), k.end(), False))
                at = k.end()
        elif w in (b"if", b"unless", b"while", b"until", b"case", b"for", b"begin"):
            if fresh or w in (b"case", b"begin", b"for"):
                stack.append(None)
                loop = w in (b"while", b"until", b"for")
        elif w == b"do":
            if loop:
                loop = False
            else:
                stack.append(None)
        fresh = w in (b"then", b"else", b"do", b"begin", b"return", b"and", b"or", b"not", b"ensure", b"private", b"public", b"protected", b"module_function", b"private_class_method")
    return out


_BRACED = {"java": java, "csharp": csharp, "php": php, "rust": rust, "go": go, "c": c_family, "cpp": c_family, "javascript": javascript, "typescript": javascript, "tsx": javascript}


def parse(path: str, raw: bytes) -> list[dict]:
    """The objects of a file as rows; the first is the file itself."""
    language = language_of(path)
    starts = [0, *(m.end() for m in re.finditer(rb"\n", raw))]
    point = lambda at: {"row": (row := bisect_right(starts, at) - 1), "col": at - starts[row]}
    whole = {"name": path, "kind": "file", "language": language or "text", "context_before": [], "context_after": [], "byte_range": {"start": 0, "end": len(raw)}, "coordinates": {"start": {"row": 0, "col": 0}, "end": point(len(raw))}}
    if not language:
        return [whole]
    if language == "python":
        found = python(raw)
    elif language == "ruby":
        found = ruby(raw)
    else:
        reader = Reader(lex(raw, language), language)
        _BRACED[language](reader)
        found = reader.out
    # an outer definition comes before what it holds
    found.sort(key=lambda d: (d.start, -d.end))
    rows, open_, seen = [whole], [], set()
    for d in found:
        while open_ and open_[-1].end <= d.start:
            open_.pop()
        if d.reported and (key := (d.name, d.kind, d.start, d.end)) not in seen:
            seen.add(key)
            first, last = point(d.start), point(d.end)
            before, after = [], []
            top, bottom = -1, len(starts) + 1
            for a in open_:
                if not (a.scope and a.end >= d.end and (a.start, a.end) != (d.start, d.end)):
                    continue
                row, end = point(a.start)["row"], point(a.end)["row"]
                if top < row < first["row"]:
                    before.append(row)
                if last["row"] < end < bottom:
                    after.append(end)
                top, bottom = row, end
            rows.append({"name": d.name, "kind": d.kind, "language": language, "context_before": before, "context_after": after, "byte_range": {"start": d.start, "end": d.end}, "coordinates": {"start": first, "end": last}})
        open_.append(d)
    return rows
