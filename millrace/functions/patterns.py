"""Regular expressions, replacement templates and time formats in Spark's terms."""

from __future__ import annotations

import re

from millrace.errors import PipelineError

_UNSUPPORTED = re.compile(r"\\K|\(\?R\)|\(\?\d+\)|\(\?\(|\(\?C\d*\)|\(\?&|\(\*")


def regex(pattern: str, caseless: bool = False) -> str:
    """Java's form: dots match line ends, and ``$`` the very end alone."""
    if _UNSUPPORTED.search(pattern):
        raise PipelineError(f"the pattern {pattern!r} uses recursion, a condition, a callout or \\K")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return ("(?siu)" if caseless else "(?s)") + "".join(out)


def groups(pattern: str) -> int:
    """Number of capturing groups."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare))


def template(text: str) -> list[str | int]:
    """Literal texts and group numbers of a replacement: ``\\`` and a digit is a group, and any other character after it stands for itself."""
    out: list[str | int] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            c = text[i]
            if c.isdigit() and c.isascii():
                out.append(int(c))
                i += 1
                continue
        if out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c)
        i += 1
    return out


#: Time directives: Java's pattern, and a regular expression for what it reads.
DIRECTIVES = {
    "Y": ("yyyy", r"\d{4}"), "m": ("MM", r"\d{2}"), "d": ("dd", r"\d{2}"), "H": ("HH", r"\d{2}"), "M": ("mm", r"\d{2}"), "S": ("ss", r"\d{2}"),
    "y": ("yy", r"\d{2}"), "j": ("DDD", r"\d{3}"), "b": ("MMM", r"[A-Za-z]{3}"), "h": ("MMM", r"[A-Za-z]{3}"), "B": ("MMMM", r"[A-Za-z]+"),
    "a": ("EEE", r"[A-Za-z]{3}"), "A": ("EEEE", r"[A-Za-z]+"), "I": ("hh", r"\d{2}"), "p": ("a", r"[AaPp][Mm]"), "Z": ("zzz", r"[A-Z]+"), "z": ("xx", r"[+-]\d{4}"),
}
COMPOSED = {"T": "%H:%M:%S", "F": "%Y-%m-%d", "D": "%m/%d/%y", "R": "%H:%M", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "v": "%e-%b-%Y", "n": "\n", "t": "\t"}
#: Directives that are numbers worked out from the time.
NUMBERS = "UWVGguwCeklsP"


def time_parts(text: str) -> list[tuple[str, str]]:
    """Parts of a time's text: ("text", as it stands), ("java", a pattern of Java's) or ("number", one of NUMBERS)."""
    for k, v in COMPOSED.items():
        text = re.sub(rf"(?<!%)((?:%%)*)%{k}", lambda m, v=v: m[1] + v, text)
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            d, i = text[i + 1], i + 2
            if d == "%":
                out.append(("text", "%"))
            elif d in DIRECTIVES:
                out.append(("java", DIRECTIVES[d][0]))
            elif d in NUMBERS:
                out.append(("number", d))
            else:
                raise PipelineError(f"the time directive %{d} isn't supported")
        else:
            out.append(("text", text[i]))
            i += 1
    return out


#: What can be read besides DIRECTIVES.
_READ = {"e": "d", "k": "H", "l": "h"}


def time_format(text: str) -> tuple[str, str]:
    """Java's pattern, and a regular expression for the start of a text that it can read."""
    java, shape, literal = [], [], []
    found = [*time_parts(text), ("end", "")]
    forms = {v[0]: v[1] for v in DIRECTIVES.values()}
    for kind, x in found:
        if kind == "text":
            literal.append(x)
            continue
        if literal:
            java.append("'" + "".join(literal).replace("'", "''") + "'")
            shape.append(re.escape("".join(literal)))
            literal = []
        if kind == "java":
            java.append(x)
            shape.append(forms[x])
        elif kind == "number":
            if x not in _READ:
                raise PipelineError(f"the time directive %{x} can't be read, only written")
            java.append("pp" + _READ[x])  # padded by a blank to two
            shape.append(r"[ \d]\d")
    return "".join(java), "".join(shape)
