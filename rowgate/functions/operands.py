"""Right-hand sides of rules that name other columns: ``end_date``, ``the min
price``, ``quantity * price``, ``10% of total``, ``3 days after order_date``.

The frame's columns are the symbol table. A column is found by its name, by
its name with spaces for underscores, or in back-quotes, ignoring case. An
operand is a small tree of tuples: ``("col", name)``, ``("num", text)``,
``(op, left, right)`` and ``("shift", sign, amount, unit, base)``.
"""

from __future__ import annotations

import re

from .sql import quote_ident
from .types import is_numeric_type, is_string_type, normalize_type

_I = re.IGNORECASE
_NUMBER = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+")
_ARTICLE = re.compile(r"(?:the\s+)?(?:(?:value|values)\s+(?:of|in)\s+(?:the\s+)?)?(?:(?:column|field)\s+)?", _I)
_NOUN = re.compile(r"\s+(?:column|field|value)\b", _I)
_TIMES = re.compile(r"\*|/|(?:multiplied\s+by|divided\s+by|times)\b", _I)
_PLUS = re.compile(r"\+|-|(?:plus|minus)\b", _I)
_SHARE = re.compile(r"(\d+(?:\.\d+)?)\s*(?:%|percent)\s+of\s+", _I)
_FACTOR = re.compile(r"(twice|double|half(?:\s+of)?)\s+", _I)
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
SHIFT = re.compile(r"^(?:(at\s+least|no\s+(?:less|fewer|sooner|earlier)\s+than|at\s+most|no\s+(?:more|later)\s+than|exactly|"
                   r"(?:more|later)\s+than|(?:less|fewer|earlier)\s+than|within)\s+)?(\d+|an?|one)\s+"
                   rf"({'|'.join(UNITS)})s?\s+(after|before|from|of)\s+(.+)$", _I)


class Columns:
    """The columns of a frame, in order, with their type texts."""

    def __init__(self, types: dict[str, str]):
        self.types = dict(types)
        forms: dict[str, str] = {}
        for name in types:
            for form in (name.lower(), name.lower().replace("_", " ")):
                forms.setdefault(form, name)
        self._forms = sorted(forms.items(), key=lambda kv: -len(kv[0]))

    def at(self, text: str, pos: int = 0) -> tuple[str, int] | None:
        """The column mentioned at ``pos``: (name, position after it)."""
        if text.startswith("`", pos):
            m = re.compile(r"`((?:[^`]|``)+)`").match(text, pos)
            name = m.group(1).replace("``", "`") if m else ""
            found = next((n for n in self.types if n == name), next((n for n in self.types if n.lower() == name.lower()), None))
            return (found, m.end()) if found else None
        low = text.lower()
        for form, name in self._forms:
            end = pos + len(form)
            if form and low.startswith(form, pos) and not re.match(r"\w", text[end:end + 1]) and not re.match(r"[(.]\w", text[end:end + 2]):
                return name, end
        return None

    def leading(self, text: str) -> tuple[str, str] | None:
        """A column at the start of ``text`` and what follows it."""
        m = _ARTICLE.match(text)
        found = self.at(text, m.end()) or self.at(text)
        if not found:
            return None
        name, end = found
        noun = _NOUN.match(text, end)
        return name, text[noun.end() if noun else end:].strip()

    def operand(self, text: str):
        """The tree of an operand that takes up the whole text and names a
        column; None when it is none."""
        try:
            tree, end = self._sum(text, 0)
        except ValueError:
            return None
        return tree if not text[end:].strip() and mentions(tree) else None

    def _sum(self, text, pos):
        left, pos = self._product(text, pos)
        while True:
            pos = _space(text, pos)
            m = _PLUS.match(text, pos)
            if not m:
                return left, pos
            right, pos = self._product(text, m.end())
            left = ("-" if m.group().lower() in ("-", "minus") else "+", left, right)

    def _product(self, text, pos):
        left, pos = self._factor(text, pos)
        while True:
            pos = _space(text, pos)
            m = _TIMES.match(text, pos)
            if not m:
                return left, pos
            right, pos = self._factor(text, m.end())
            left = ("/" if m.group() == "/" or m.group().lower().startswith("div") else "*", left, right)

    def _factor(self, text, pos):
        pos = _space(text, pos)
        m = _SHARE.match(text, pos)
        if m:
            inner, pos = self._factor(text, m.end())
            return ("/", ("*", ("num", m.group(1)), inner), ("num", "100")), pos
        m = _FACTOR.match(text, pos)
        if m:
            inner, pos = self._factor(text, m.end())
            return (("*", ("num", "2"), inner) if m.group(1).lower() in ("twice", "double") else ("/", inner, ("num", "2"))), pos
        if text.startswith("(", pos):
            inner, pos = self._sum(text, pos + 1)
            pos = _space(text, pos)
            if not text.startswith(")", pos):
                raise ValueError(text)
            return inner, pos + 1
        for start in dict.fromkeys((_ARTICLE.match(text, pos).end(), pos)):
            found = self.at(text, start)
            if found:
                name, end = found
                noun = _NOUN.match(text, end)
                return ("col", name), noun.end() if noun else end
        m = _NUMBER.match(text, pos)
        if not m:
            raise ValueError(text)
        return ("num", m.group().replace(",", "")), m.end()


def _space(text: str, pos: int) -> int:
    return pos + len(text[pos:]) - len(text[pos:].lstrip())


def mentions(tree) -> set[str]:
    """Names of the columns in an operand."""
    if tree[0] == "col":
        return {tree[1]}
    return set().union(*[mentions(t) for t in tree[1:] if isinstance(t, tuple)]) if any(isinstance(t, tuple) for t in tree) else set()


def shifted(quantity: str | None, amount: str, unit: str, side: str, base) -> tuple[str, list] | None:
    """``at least 3 days after x`` as (comparison, bounds): the comparison is
    one of the usual ones with one bound, or ``between`` with two."""
    words = re.sub(r"\s+", " ", (quantity or "exactly").lower())
    n = "1" if not amount.isdigit() else amount
    later, earlier = ("shift", "+", n, unit.lower(), base), ("shift", "-", n, unit.lower(), base)
    side = side.lower()
    if words == "within":
        return "between", {"of": [earlier, later], "after": [base, later], "from": [base, later], "before": [earlier, base]}[side]
    if side == "of":
        return None
    least = words in ("at least",) or re.fullmatch(r"no (less|fewer|sooner|earlier) than", words)
    op = "=" if words == "exactly" else ">=" if least else ">" if words.startswith("more") or words == "later than" else \
        "<" if re.match(r"(less|fewer|earlier) than", words) else "<="
    if side == "before":  # further before is smaller
        return {"=": "=", ">=": "<=", ">": "<", "<=": ">=", "<": ">"}[op], [earlier]
    return op, [later]


def is_time_type(data_type: str) -> bool:
    return normalize_type(data_type).startswith(("date", "timestamp"))


def operand_type(tree, data_type: str, types: dict[str, str]) -> str:
    """The type in which a column of ``data_type`` is compared with the operand."""
    if tree[0] == "shift":
        return data_type if is_time_type(data_type) else "timestamp"
    if tree[0] != "col":
        return data_type if is_numeric_type(data_type) else "double"
    other = types.get(tree[1], "string")
    if is_string_type(data_type) and (is_numeric_type(other) or is_time_type(other)):
        return "double" if is_numeric_type(other) else other
    return data_type


def operand_sql(tree, target: str, types: dict[str, str]) -> str:
    """SQL of an operand as ``target``; values that cannot take a type are NULL."""
    kind = tree[0]
    if kind == "col":
        c, own = quote_ident(tree[1]), normalize_type(types.get(tree[1], "string"))
        return c if own == normalize_type(target) else f"TRY_CAST({c} AS {normalize_type(target).upper()})"
    if kind == "num":
        return tree[1]
    if kind == "shift":
        base = operand_sql(tree[4], target, types)
        return f"try_{'add' if tree[1] == '+' else 'subtract'}({base}, INTERVAL '{tree[2]}' {tree[3].upper()})"

    def number(t):
        if t[0] == "col" and is_numeric_type(types.get(t[1], "string")):
            return quote_ident(t[1])
        return operand_sql(t, "double", types)
    # an overflow or a division by zero is not applicable (NULL)
    call = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide"}[kind]
    return f"{call}({number(tree[1])}, {number(tree[2])})"
