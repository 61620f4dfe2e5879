"""Row filters given as data-frame query strings, as column predicates.

``a > 1 & kind in ["x", "y"]``, ``not (0 < a <= 5) or `odd name` != 3``: Python reads the expression (``ast``), and each
of its nodes becomes a Column, so the filter is pushed down like any other. ``&``, ``|`` and ``~`` bind like ``and``,
``or`` and ``not``; comparisons chain; ``==`` and ``!=`` with a list mean membership; column names that are no Python
names go in backticks.

Missing values compare as in a data frame: a NULL is unequal to everything, so ``!=`` and ``not in`` hold for it and all
other comparisons do not. Whatever else an expression holds is an error, before any row is read.
"""

from __future__ import annotations

import ast
import io
import operator
import re
import tokenize

from pyspark.sql import Column, functions as F

ORDER = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
              ast.Mod: operator.mod, ast.Pow: operator.pow}
WORDS = {"&": "and", "|": "or", "~": "not"}


def _read(query: str) -> tuple[ast.expr, dict[str, str]]:
    """The expression and the columns behind the names that stand for backticks."""
    quoted: dict[str, str] = {}

    def stand_in(found: re.Match) -> str:
        if found[1] is None:
            return found[0]  # a text in quotes
        name = f"_quoted_{len(quoted)}"
        quoted[name] = found[1]
        return name

    plain = re.sub(r"""`([^`]+)`|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", stand_in, query.strip())
    tokens = [(tokenize.NAME, WORDS[t.string]) if t.type == tokenize.OP and t.string in WORDS else (t.type, t.string)
              for t in tokenize.generate_tokens(io.StringIO(plain).readline)]
    return ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body, quoted


def _literal(node: ast.expr):
    """A constant, or a list of constants; else an error."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return -node.operand.value
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_literal(x) for x in node.elts]
    raise ValueError(f"not a constant: {ast.unparse(node)}")


class _Translator:
    def __init__(self, quoted: dict[str, str]):
        self.quoted = quoted

    def value(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return F.col("`" + self.quoted.get(node.id, node.id).replace("`", "``") + "`")
        if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](self.value(node.left), self.value(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.value(node.operand)
        if isinstance(node, (ast.Constant, ast.List, ast.Tuple)):
            found = _literal(node)
            if isinstance(found, list):
                raise ValueError(f"a list only goes with in, not in, == and !=: {ast.unparse(node)}")
            return F.lit(found)
        raise ValueError(f"not part of a query: {ast.unparse(node)}")

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr, plain: bool) -> Column:
        """``plain``: NULL may stand for false, as in a filter; that keeps the comparison as the scan knows it."""
        known = (lambda c: c) if plain else (lambda c: F.coalesce(c, F.lit(False)))
        many = isinstance(right, (ast.List, ast.Tuple))
        if isinstance(op, (ast.In, ast.NotIn)) or many and isinstance(op, (ast.Eq, ast.NotEq)):
            held = _literal(right)
            if not isinstance(held, list):
                raise ValueError(f"membership needs a list: {ast.unparse(right)}")
            hit = self.value(left).isin(held) if held else F.lit(False)
            return known(hit) if isinstance(op, (ast.In, ast.Eq)) else ~F.coalesce(hit, F.lit(False))
        one, other = self.value(left), self.value(right)
        if isinstance(op, ast.Eq):
            return known(one == other)
        if isinstance(op, ast.NotEq):
            return F.coalesce(one != other, F.lit(True))
        if type(op) in ORDER:
            return known(ORDER[type(op)](one, other))
        raise ValueError(f"not a comparison of a query: {type(op).__name__}")

    def test(self, node: ast.expr, plain: bool) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.test(x, plain) for x in node.values]
            join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
            found = parts[0]
            for part in parts[1:]:
                found = join(found, part)
            return found
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.test(node.operand, False)
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            found = self.compare(sides[0], node.ops[0], sides[1], plain)
            for left, op, right in zip(sides[1:], node.ops[1:], sides[2:]):
                found = found & self.compare(left, op, right, plain)
            return found
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.coalesce(self.value(node), F.lit(False))
        raise ValueError(f"not a condition: {ast.unparse(node)}")


def condition(query: str) -> Column:
    """The condition of a query string for a filter, where NULL counts as false."""
    if not isinstance(query, str):
        raise ValueError(f"query must be a string: {query!r}")
    try:
        expression, quoted = _read(query)
    except (SyntaxError, tokenize.TokenError) as error:
        raise ValueError(f"cannot read the query {query!r}: {error}") from error
    return _Translator(quoted).test(expression, True)


def predicate(query: str) -> Column:
    """The same as a value that is never NULL."""
    return F.coalesce(condition(query), F.lit(False))
