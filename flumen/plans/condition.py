"""The condition language over flows, from text to a Column.

    disjunction  -> conjunction ('|' conjunction)*      conjunction -> negation ('&' negation)*
    negation     -> '!' primitive | primitive           primitive   -> '(' disjunction ')' | condition
    condition    -> attribute comparator value

Case does not matter. Word forms of operators are read where the grammar expects an operator, so a value
may be spelled like one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.net import cidr_range, is_ip, parse_ip
from ..functions.protocols import NUMBERS

# Attributes and the accepted spellings of operators.
ATTRIBUTES = ("dip", "sip", "dnet", "snet", "dport", "proto", "dst", "src", "host", "net")
COMPARATORS = {
    "=": ("=", "==", "===", "eq", "-eq", "equals"),
    "!=": ("!=", "neq", "-neq", "ne", "-ne"),
    "<=": ("<=", "le", "-le", "leq", "-leq"),
    ">=": (">=", "ge", "-ge", "geq", "-geq"),
    ">": (">", "g", "-g", "gt", "-gt", "greater"),
    "<": ("<", "l", "-l", "lt", "-lt", "less"),
}
AND, OR, NOT = ("&", "&&", "*", "and"), ("|", "||", "+", "or"), ("!", "not")
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
INVERSE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}

_SPELLED = {s: c for c, spellings in COMPARATORS.items() for s in spellings}
_TOKEN = re.compile(r"\s+|===|==|!=|<=|>=|&&|\|\||[=<>!&|*+()\[\]{}]|[^\s=<>!&|*+()\[\]{}]+")


class ConditionError(ValueError):
    """Carries the tokens with a mark under the offending one."""

    def __init__(self, what: str, tokens: list[str], at: int):
        before = " ".join(tokens[:at])
        mark = " " * (len(before) + bool(before)) + "^"
        super().__init__(f"{what}\n{' '.join(tokens)}\n{mark}")


@dataclass(frozen=True)
class Condition:
    attribute: str
    comparator: str
    value: str

    def __str__(self):
        return f"{self.attribute} {self.comparator} {self.value}"


@dataclass(frozen=True)
class Not:
    node: Node

    def __str__(self):
        return f"!({self.node})"


@dataclass(frozen=True)
class And:
    left: Node
    right: Node

    def __str__(self):
        return f"({self.left} & {self.right})"


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node

    def __str__(self):
        return f"({self.left} | {self.right})"


Node = Condition | Not | And | Or


def tokenize(text: str) -> list[str]:
    if not text.isascii():
        raise ValueError("conditions are ASCII text")
    return [t for t in _TOKEN.findall(text.lower()) if not t.isspace()]


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, what: str, accepted: Callable[[str], bool]) -> str:
        token = self.peek()
        if not token or not accepted(token):
            raise ConditionError(f"expected {what}", self.tokens, self.at)
        self.at += 1
        return token

    def binary(self, operand, words, kind):
        """Operands joined by one operator, as a tree that hangs to the right."""
        nodes = [operand()]
        while self.peek() in words:
            self.at += 1
            nodes.append(operand())
        tree = nodes.pop()
        while nodes:
            tree = kind(nodes.pop(), tree)
        return tree

    def disjunction(self):
        return self.binary(self.conjunction, OR, Or)

    def conjunction(self):
        return self.binary(self.negation, AND, And)

    def negation(self):
        if self.peek() in NOT:
            self.at += 1
            return Not(self.primitive())
        return self.primitive()

    def primitive(self):
        if self.peek() in OPEN:
            self.at += 1
            node = self.disjunction()
            self.take("')'", CLOSE.__contains__)
            return node
        attribute = self.take("an attribute", ATTRIBUTES.__contains__)
        comparator = _SPELLED[self.take("a comparator", _SPELLED.__contains__)]
        value = self.take("a value", lambda t: re.match(r"[^=<>!&|*+()\[\]{}]", t) is not None)
        return Condition(attribute, comparator, value)


def parse(text: str) -> Node | None:
    """The tree of a condition, None for an empty one."""
    tokens = tokenize(text)
    if not tokens:
        return None
    parser = _Parser(tokens)
    node = parser.disjunction()
    if parser.at < len(tokens):
        raise ConditionError("expected the end", tokens, parser.at)
    return node


def rewrite(node: Node, leaf: Callable[[Condition], Node]) -> Node:
    if isinstance(node, Condition):
        return leaf(node)
    if isinstance(node, Not):
        return Not(rewrite(node.node, leaf))
    return type(node)(rewrite(node.left, leaf), rewrite(node.right, leaf))


def desugar(node: Node) -> Node:
    """src, dst, host and net in terms of sip, dip, snet and dnet."""

    def leaf(c: Condition) -> Node:
        if c.attribute in ("src", "dst"):
            return Condition({"src": "sip", "dst": "dip"}[c.attribute], c.comparator, c.value)
        if c.attribute in ("host", "net"):
            if c.comparator not in ("=", "!="):
                raise ValueError(f"{c.attribute} takes = and != only: {c}")
            pair = ("sip", "dip") if c.attribute == "host" else ("snet", "dnet")
            either = Or(*[Condition(a, "=", c.value) for a in pair])
            return Not(either) if c.comparator == "!=" else either
        return c

    return rewrite(node, leaf)


def resolve(node: Node, resolver: Callable[[str], list[str]] | None) -> Node:
    """Host names in sip and dip conditions, replaced by the addresses that ``resolver`` gives.

    A name equals any of its addresses; it differs if it differs from all of them.
    """

    def leaf(c: Condition) -> Node:
        if c.attribute not in ("sip", "dip") or is_ip(c.value) or ":" in c.value or re.fullmatch(r"[0-9.]+", c.value):
            return c
        found = resolver(c.value) if resolver else []
        if not found:
            raise ValueError(f"could not resolve {c.value!r}")
        tree: Node = Condition(c.attribute, c.comparator, found[-1])
        for address in reversed(found[:-1]):
            tree = (And if c.comparator == "!=" else Or)(Condition(c.attribute, c.comparator, address), tree)
        return tree

    return rewrite(node, leaf)


def negation_normal_form(node: Node, flip: bool = False) -> Node:
    if isinstance(node, Condition):
        return Condition(node.attribute, INVERSE[node.comparator], node.value) if flip else node
    if isinstance(node, Not):
        return negation_normal_form(node.node, not flip)
    kind = type(node) if not flip else (Or if isinstance(node, And) else And)
    return kind(negation_normal_form(node.left, flip), negation_normal_form(node.right, flip))


def _number(c: Condition, most: int, names: dict | None = None) -> int:
    if c.value.isdigit() and int(c.value) <= most:
        return int(c.value)
    if names and c.value in names:
        return names[c.value]
    raise ValueError(f"could not parse the {c.attribute} value {c.value!r}")


def _compare(column: Column, comparator: str, value) -> Column:
    return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[comparator]


def condition_column(c: Condition) -> Column:
    """A predicate that Parquet statistics can serve: networks are ranges of addresses."""
    if c.attribute == "dport":
        return _compare(F.col("dport"), c.comparator, F.lit(_number(c, 65_535)))
    if c.attribute == "proto":
        return _compare(F.col("proto"), c.comparator, F.lit(_number(c, 255, NUMBERS)))
    if c.comparator not in ("=", "!="):
        raise ValueError(f"{c.attribute} takes = and != only: {c}")
    if c.attribute in ("sip", "dip"):
        return _compare(F.col(c.attribute), c.comparator, F.lit(bytearray(parse_ip(c.value))))
    low, high = cidr_range(c.value)
    inside = F.col({"snet": "sip", "dnet": "dip"}[c.attribute]).between(F.lit(bytearray(low)), F.lit(bytearray(high)))
    return inside if c.comparator == "=" else ~inside


def tree_column(node: Node) -> Column:
    if isinstance(node, Condition):
        return condition_column(node)
    if isinstance(node, Not):
        return ~tree_column(node.node)
    left, right = tree_column(node.left), tree_column(node.right)
    return left & right if isinstance(node, And) else left | right


def compile_condition(text: str, resolver: Callable[[str], list[str]] | None = None) -> Column | None:
    """Text to a Column; None for an empty condition. Errors show before any data is read."""
    node = parse(text)
    if node is None:
        return None
    return tree_column(negation_normal_form(resolve(desugar(node), resolver)))


def columns_of(text: str) -> set[str]:
    """Flow columns that a condition reads."""
    node = parse(text)
    found: set = set()
    if node is not None:
        rewrite(desugar(node), lambda c: (found.add({"snet": "sip", "dnet": "dip"}.get(c.attribute, c.attribute)), c)[1])
    return found
