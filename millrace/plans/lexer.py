"""Tokens of the pipeline language."""

from __future__ import annotations

from dataclasses import dataclass

from millrace.errors import PipelineError

#: Symbols, of which the longest that fits is taken.
SYMBOLS = sorted(("=", "!=", "<>", "<", ">", "<=", ">=", "+", "-", "*", "/", "%", "&", "|", "~", "&&", "||", "!", "(", ")", ",", ";"), key=len, reverse=True)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}


@dataclass(frozen=True)
class Token:
    kind: str  # string, int, uint, double, name, symbol, raw, argument
    text: str
    line: int

    def __str__(self) -> str:
        return self.text


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    i, line, n = 0, 1, len(source)
    while i < n:
        c = source[i]
        start = i
        if c == "\n":
            line += 1
            i += 1
        elif c.isspace():
            i += 1
        elif c == "#":
            i = source.find("\n", i) if "\n" in source[i:] else n
        elif source.startswith("@@@", i):
            end = source.find("@@@", i + 3)
            if end < 0:
                raise PipelineError("a @@@ block has no end", line=line)
            out.append(Token("raw", source[i + 3 : end], line))
            line += source.count("\n", i, end)
            i = end + 3
        elif c in "'\"":
            text, i = [], i + 1
            while i < n and source[i] != c:
                if source[i] == "\\" and i + 1 < n:
                    e = source[i + 1]
                    text.append(ESCAPES.get(e) or (e if e == c else "\\" + e))
                    i += 2
                else:
                    text.append(source[i])
                    i += 1
            if i >= n:
                raise PipelineError("a string has no end", line=line)
            out.append(Token("string", "".join(text), line))
            line += source.count("\n", start, i)
            i += 1
        elif c.isdigit():
            while i < n and source[i].isdigit():
                i += 1
            kind = "int"
            if i < n and source[i] == ".":
                kind, i = "double", i + 1
                while i < n and source[i].isdigit():
                    i += 1
                if i < n and source[i] in "eE":
                    i += 1 + (i + 1 < n and source[i + 1] in "+-")
                    while i < n and source[i].isdigit():
                        i += 1
            text = source[start:i]
            if kind == "int" and i < n and source[i] == "U":
                kind, i = "uint", i + 1
            out.append(Token(kind, text, line))
        elif c.isalpha() or c == "_":
            while i < n and (source[i].isalnum() or source[i] in "_.:"):
                i += 1
            out.append(Token("name", source[start:i], line))
        elif c == "$" and i + 1 < n and source[i + 1].isdigit():
            i += 1
            while i < n and source[i].isdigit():
                i += 1
            out.append(Token("argument", source[start + 1 : i], line))
        else:
            symbol = next((s for s in SYMBOLS if source.startswith(s, i)), None)
            if symbol is None:
                raise PipelineError(f"unexpected character {c!r}", line=line)
            out.append(Token("symbol", symbol, line))
            i += len(symbol)
    return out


def split_commas(found: list[Token]) -> list[list[Token]]:
    """Tokens between commas outside parentheses; no tokens give no parts."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in found:
        if t.kind == "symbol":
            depth += (t.text == "(") - (t.text == ")")
            if t.text == "," and not depth:
                parts.append([])
                continue
        parts[-1].append(t)
    if parts == [[]]:
        return []
    if not all(parts):
        raise PipelineError("an argument is empty", line=found[0].line if found else None)
    return parts
