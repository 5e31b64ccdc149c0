"""Expressions: tokens to a tree, by precedence climbing."""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.errors import PipelineError
from millrace.plans.lexer import Token

#: How tightly an operator binds; the tightest has the lowest number, as in C.
BINARY = {"*": 5, "/": 5, "%": 5, "+": 6, "-": 6, "<": 8, ">": 8, "<=": 8, ">=": 8, "=": 9, "!=": 9, "&": 10, "|": 12, "&&": 13, "||": 14}
WORDS = {"and": "&&", "or": "||", "not": "!", "mod": "%", "concat": "+", "<>": "!="}
LOOSEST = 14


@dataclass
class Node:
    kind: str  # literal, column, call, if
    line: int
    tag: str = ""
    value: object = None
    name: str = ""
    args: list[Node] = field(default_factory=list)

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


class Parser:
    def __init__(self, found: list[Token]):
        self.found, self.at = found, 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.found[self.at + ahead] if self.at + ahead < len(self.found) else None

    def fail(self, message: str):
        t = self.peek() or (self.found[-1] if self.found else None)
        raise PipelineError(message + (f" near {t.text!r}" if t else ""), line=t.line if t else None)

    def take(self, text: str) -> Token:
        t = self.peek()
        if t is None or t.kind not in ("symbol", "name") or t.text != text:
            self.fail(f"{text!r} is missing")
        self.at += 1
        return t

    def operator(self) -> str | None:
        t = self.peek()
        if t is None or t.kind not in ("symbol", "name"):
            return None
        return WORDS.get(t.text, t.text if t.kind == "symbol" else None)

    def whole(self) -> Node:
        out = self.expression()
        if self.peek() is not None:
            self.fail("something follows the expression")
        return out

    def expression(self, loosest: int = LOOSEST) -> Node:
        left = self.unary()
        while (op := self.operator()) in BINARY and BINARY[op] <= loosest:
            line = self.peek().line
            self.at += 1
            right = self.expression(BINARY[op] - 1)
            left = Node("call", line, name=op, args=[left, right])
        return left

    def unary(self) -> Node:
        op = self.operator()
        if op in ("-", "!", "~"):
            line = self.peek().line
            self.at += 1
            return Node("call", line, name="negate" if op == "-" else op, args=[self.unary()])
        return self.primary()

    def primary(self) -> Node:
        t = self.peek()
        if t is None:
            self.fail("an operand is missing")
        if t.kind == "symbol" and t.text == "(":
            self.at += 1
            out = self.expression()
            self.take(")")
            return out
        self.at += 1
        if t.kind == "string":
            return Node("literal", t.line, tag="string", value=t.text)
        if t.kind in ("int", "uint"):
            value = int(t.text) & (1 << 64) - 1
            return Node("literal", t.line, tag=t.kind, value=value - (1 << 64) if value >> 63 else value)
        if t.kind == "double":
            return Node("literal", t.line, tag="double", value=float(t.text))
        if t.kind != "name":
            self.at -= 1
            self.fail("an operand is missing")
        if t.text in ("true", "false"):
            return Node("literal", t.line, tag="bool", value=t.text == "true")
        opens = self.peek() is not None and self.peek().kind == "symbol" and self.peek().text == "("
        if t.text == "if" and opens:
            args = []
            for word in ("then", "else", None):
                self.take("(")
                args.append(self.expression())
                self.take(")")
                if word:
                    self.take(word)
            return Node("if", t.line, args=args)
        if not opens:
            return Node("column", t.line, name=t.text)
        self.at += 1
        args = []
        if not (self.peek() is not None and self.peek().text == ")" and self.peek().kind == "symbol"):
            args.append(self.expression())
            while self.peek() is not None and self.peek().kind == "symbol" and self.peek().text == ",":
                self.at += 1
                args.append(self.expression())
        self.take(")")
        return Node("call", t.line, name=t.text, args=args)


def parse(found: list[Token]) -> Node:
    return Parser(found).whole()
