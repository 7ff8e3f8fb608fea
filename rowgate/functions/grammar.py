"""Closed grammar that turns natural-language rule text into one boolean
Spark SQL expression (``true`` = valid, NULL input passes unless the rule is a
not-null rule).

The grammar replaces a language model: every rule family the tool documents
(not null, unique, in-list, email, numeric comparison, "is a number",
compounds, free SQL) has a pattern here; text that matches nothing raises
``RuleSyntaxError`` so the caller can report it or hand it to a translator.

With the columns of the frame as symbol table a rule may also name other
columns: as the right side of a comparison (``before end_date``, ``at least 3
days after order_date``, ``equal to quantity * price``), as its subject
(``status must be 'A'``) and in conditions (``if status is 'A' then price must
be positive``). A condition that is NULL makes the rule not applicable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .fixed import EMAIL_REGEX
from .operands import SHIFT, Columns, is_time_type, operand_sql, operand_type, shifted
from .sql import is_number, quote_ident, quote_str
from .types import is_numeric_type, is_string_type, normalize_type


class RuleSyntaxError(ValueError):
    """Rule text the grammar does not understand."""


@dataclass(frozen=True)
class Spec:
    kind: str
    op: str | None = None
    values: tuple = ()
    text: str | None = None
    parts: tuple = field(default=())


_I = re.IGNORECASE

# Leading filler: "the value must be", "should always be", "is", ...
_FILLER = re.compile(
    r"^(?:the\s+)?(?:(?:column|field)\s+)?(?:values?\s+|it\s+)?"
    r"(?:(?:must|should|shall|has\s+to|have\s+to|needs\s+to|need\s+to|will|can)\s+)?"
    r"(?:always\s+)?(?:be\s+|is\s+|are\s+)?",
    _I,
)

_NOT_NULL = re.compile(
    r"^(?:(?:must|should|shall|can|may)\s*(?:not|n't)\s+be\s+null"
    r"|cannot\s+be\s+null|is\s+not\s+null|not\s+(?:be\s+)?null|non[-\s]?null"
    r"|(?:is\s+)?required|mandatory|(?:must|should)\s+(?:be\s+)?(?:present|populated|provided))$",
    _I,
)
_BARE_ONE_OF = re.compile(r"^(?:either\s+)?(?:one|any)\s+of\s*:?\s*([^\[\(\{].*)$", _I)
_QUOTED = r"(?:'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")"
_OR_LIST = re.compile(rf"^(?:either\s+)?({_QUOTED}(?:\s*(?:,|or)\s*{_QUOTED})+)$", _I)
_IS_NULL = re.compile(r"^(?:null|empty\s+\(null\)|missing|absent)$", _I)
_ALLOWED = re.compile(r"^(?:allowed|valid|accepted|permitted|possible)\s+values?\s*(?:are|is|:)?\s*(.+)$", _I)
_VALID_TYPE = re.compile(r"^(?:an?\s+)?(?:valid|proper|parsable|parseable)\s+"
                         r"(date|timestamp|datetime|integer|int|bigint|long|double|float|decimal|boolean|bool)"
                         r"(?:\s+value)?$", _I)
_FORMAT = re.compile(r"^(?:in\s+)?(?:the\s+)?(?:(date|timestamp|datetime)\s+)?format\s*:?\s*(.+)$", _I)
_TIME = re.compile(r"^(?:(?:a\s+)?date\s+)?(?:in\s+the\s+(past|future)|not\s+in\s+the\s+(future|past))$", _I)
_SHAPE = re.compile(r"^(?:all\s+)?(upper\s*case|lower\s*case|alpha\s*numeric|digits\s+only|only\s+digits|"
                    r"(?:a\s+)?valid\s+url)$", _I)
_UNIQUE = re.compile(r"^(?:unique|distinct|no\s+duplicates?)(?:\s+values?)?$", _I)
_EMAIL = re.compile(r"^(?:(?:in|have|has|of|follow|follows|match|matches|formatted\s+as|contain|contains)\s+)?(?:an?\s+|the\s+)?"
                    r"(?:(?:valid|proper|correct|properly\s+formatted|well[-\s]?formed)\s+e-?mail(?:\s+address(?:es)?)?(?:\s+format)?"
                    r"|e-?mail(?:\s+address)?\s+format|e-?mail\s+address(?:es)?)$", _I)
_EMAIL_SUBJECT = re.compile(r"^(?:the\s+)?e-?mail(?:\s+address)?\s+(?:must|should|has\s+to|needs\s+to|is|shall)\s+(?:be\s+)?"
                            r"(?:valid|well[-\s]?formed|properly\s+formatted)$", _I)
_INTEGER = re.compile(r"^(?:an?\s+)?(?:integer|whole\s+number|int)(?:\s+(?:value|number))?$", _I)
_BOOL = re.compile(r"^(?:equal\s+to\s+|equals\s+)?(true|false)$", _I)
_NOT = re.compile(r"^not\s+(?:be\s+|an?\s+)?(.+)$", _I | re.S)
_N_CHARS = re.compile(r"^(?:exactly\s+)?(\d+)\s+(?:characters?|chars?|letters?)(?:\s+(?:long|in\s+length))?$", _I)
_NUMBER = re.compile(r"^(?:an?\s+)?(?:valid\s+)?(?:number|numeric(?:\s+value)?|numerical)$", _I)
_IN_LIST = re.compile(
    r"^(?:(?:one|any)\s+of|in|among|within)(?:\s+the\s+(?:values|list))?\s*:?\s*([\[\(\{].*[\]\)\}])$",
    _I,
)
_REGEX = re.compile(
    r"^(?:match(?:es)?|follow(?:s)?)\s+(?:the\s+)?(?:regex|regular\s+expression|pattern)\s*:?\s*(.+)$", _I
)
_NOT_EMPTY = re.compile(r"^(?:not\s+(?:be\s+)?(?:empty|blank)|non[-\s]?(?:empty|blank)|cannot\s+be\s+(?:empty|blank))$", _I)
_AFFIX = re.compile(r"^(start|begin|end)s?\s+with\s+(.+)$|^(contain)s?\s+(.+)$", _I)
_SIGN = re.compile(r"^(?:an?\s+)?(non[-\s]?negative|non[-\s]?positive|positive|negative|zero\s+or\s+positive)"
                   r"(?:\s+(?:number|value|integer))?$", _I)

# Comparison phrases, longest first.
_OPS: list[tuple[str, str]] = [
    (r"(?:greater|more|larger|bigger|higher)\s+than\s+or\s+equal\s+to", ">="),
    (r"(?:less|smaller|lower|fewer)\s+than\s+or\s+equal\s+to", "<="),
    (r"not\s+(?:exceed|be\s+(?:greater|more|larger|higher)\s+than|be\s+above)", "<="),
    (r"not\s+(?:be\s+)?(?:less|smaller|lower|fewer)\s+than|not\s+be\s+below", ">="),
    (r"at\s+least|no\s+(?:less|fewer)\s+than|not\s+less\s+than|minimum(?:\s+of)?|min", ">="),
    (r"at\s+most|no\s+more\s+than|not\s+more\s+than|maximum(?:\s+of)?|max|up\s+to", "<="),
    (r"(?:greater|more|larger|bigger|higher)\s+than|above|over|exceeds?|after", ">"),
    (r"(?:less|smaller|lower|fewer)\s+than|below|under|before", "<"),
    (r"not\s+equal(?:\s+to)?|different\s+from|other\s+than", "<>"),
    (r"equals?(?:\s+to)?|exactly", "="),
    (r">=|=>", ">="),
    (r"<=|=<", "<="),
    (r"!=|<>", "<>"),
    (r"==|=", "="),
    (r">", ">"),
    (r"<", "<"),
]
_GROUPED = r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?"  # thousands separators
_VALUE = r"(" + _GROUPED + r"(?![\d,])|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)"
_CMP = [(re.compile(rf"^(?:{pat})\s*{_VALUE}$", _I), op) for pat, op in _OPS]
_BETWEEN = re.compile(rf"^(?:between|in\s+the\s+range|in\s+range|from)\s+{_VALUE}\s+(?:and|to|-)\s+{_VALUE}(?:\s+inclusive)?$", _I)
_LEN_PREFIX = re.compile(r"^(?:(?:the\s+)?(?:string\s+)?(?:length|len|size)(?:\s+of\s+the\s+value)?)\s+(?:must\s+be\s+|should\s+be\s+|is\s+|of\s+)?(.+)$", _I)
_LEN_PREFIX2 = re.compile(r"^(min|max|minimum|maximum)\s+length\s*(?:of\s+)?(.+)$", _I)
_LEN_SUFFIX = re.compile(r"^(.+?)\s+(?:characters?|chars?|letters?)(?:\s+long)?$", _I)
_SQL = re.compile(r"^sql\s*:\s*(.+)$", _I | re.S)
_TRUE = re.compile(r"^(?:true|always\s+valid|any(?:thing)?|no\s+rule)$", _I)
_QUOTED_OR_BARE = re.compile(rf"\s*(?:({_QUOTED})|([^,]*?))\s*(?:,|$)", re.S)
_SPACES = re.compile(rf"({_QUOTED})|\s+", re.S)


_CONTRACTED = re.compile(rf"\b(?:can't|cannot|(\w+)n't)\b|({_QUOTED})", re.I | re.S)


def _squeeze(text: str) -> str:
    """Runs of white space outside quotes become one space."""
    return _SPACES.sub(lambda m: m.group(1) or " ", text.strip())


def _unquote(token: str) -> str:
    """The one literal codec of rule text: inside quotes a backslash takes the
    next character as it is, and a doubled single quote is a quote.
    ``format_value_list`` writes what this reads."""
    if len(token) >= 2 and token[0] == token[-1] and token[0] in "'\"":
        body = token[1:-1]
        pairs = r"\\(.)|''" if token[0] == "'" else r"\\(.)"
        return re.sub(pairs, lambda m: m.group(1) if m.group(1) is not None else "'", body, flags=re.S)
    return token


def _value(token: str):
    """Literal from a matched value token: numbers stay numeric text."""
    if token[:1] in "'\"":
        return ("str", _unquote(token))
    if re.fullmatch(_GROUPED, token):
        return ("num", token.replace(",", ""))
    if is_number(token):
        return ("num", token)
    return ("str", token)


def _phrase(token: str) -> str:
    """A value given as free text: quoted whole, or without any quote."""
    token = token.strip()
    if re.fullmatch(_QUOTED, token, re.S):
        return _unquote(token)
    if token[:1] in "'\"" or re.search(rf"\s(?:and|or)\s|^{_QUOTED}\s", token, _I):
        raise RuleSyntaxError(f"quote the value {token!r} as a whole")
    return token


def parse_list(text: str) -> tuple:
    """Values of a bracketed list: quoted ones verbatim, others split at commas only."""
    inner = text.strip()[1:-1]
    out, at = [], 0
    while at < len(inner):
        m = _QUOTED_OR_BARE.match(inner, at)
        if not m or (m.group(1) is None and ("'" in m.group(2) or '"' in m.group(2)) and m.group(2)[:1] in "'\""):
            raise RuleSyntaxError(f"value list not understood at {inner[at:]!r}")
        if m.group(1) is not None:
            out.append(("str", _unquote(m.group(1))))
        elif m.group(2):
            out.append(_value(m.group(2)))
        at = m.end()
    return tuple(out)


def _open_range(before: str, cols: Columns | None) -> bool:
    """Whether the text ends in the first half of ``between A and B``."""
    m = re.search(r"\b(?:between|range|from)\s+((?:(?!\b(?:between|range|from)\b).)+)$", before, _I)
    return bool(m) and bool(re.fullmatch(_VALUE, m.group(1).strip(), _I) or (cols and cols.operand(m.group(1).strip())))


_CLASS_WORD = re.compile(r"(?:digits?|numbers?|letters?|alpha|(?:upper|lower)\s*case|(?:white\s*)?spaces?|underscores?|hyphens?|dashes|dots|periods?)\b", _I)


def _open_classes(before: str, after: str) -> bool:
    """Whether the text ends inside ``only letters and digits``."""
    return bool(re.search(r"\bonly\s+[\w\s,]+$", before, _I) and _CLASS_WORD.match(after))


def _split(text: str, word: str, cols: Columns | None = None) -> list[str]:
    """Split at `` word `` outside quotes and brackets, keeping ``between A and
    B``, ``... than or equal to`` and ``zero or positive`` whole."""
    parts, start, depth, quote, i = [], 0, 0, None, 0
    low, gap = text.lower(), f" {word} "
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 2
                continue
            if ch == quote:
                quote = None
        elif ch in "'\"" and (i == 0 or not text[i - 1].isalnum()):  # an apostrophe inside a word opens nothing
            quote = ch
        elif ch in "[({":
            depth += 1
        elif ch in "])}":
            depth -= 1
        elif depth == 0 and low.startswith(gap, i):
            before, after = text[start:i], low[i + len(gap):]
            held = (_open_range(before, cols) or _open_classes(before, after) if word == "and" else
                    re.match(r"equal\b", after) or (re.search(r"\bzero$", before, _I) and after.startswith("positive")))
            if not held:
                parts.append(before.strip())
                start = i + len(gap)
                i = start
                continue
        i += 1
    parts.append(text[start:].strip())
    if quote or depth:
        raise RuleSyntaxError(f"open quote or bracket in {text!r}")
    return [p for p in parts if p]


def _parse_cmp(core: str, cols: Columns | None = None) -> Spec | None:
    m = _BETWEEN.match(core)
    if m:
        return Spec("between", values=(_value(m.group(1)), _value(m.group(2))))
    for pat, op in _CMP:
        m = pat.match(core)
        if m:
            return Spec("cmp", op=op, values=(_value(m.group(1)),))
    if cols is not None:
        spec = _parse_relation(core, cols)
        if spec:
            return spec
    m = _SIGN.match(core)
    if m:
        word = re.sub(r"[-\s]+", " ", m.group(1).lower())
        op = {"positive": ">", "negative": "<", "non negative": ">=", "nonnegative": ">=",
              "non positive": "<=", "nonpositive": "<=", "zero or positive": ">="}[word]
        return Spec("cmp", op=op, values=(("num", "0"),))
    return None


_OPEN_CMP = [(re.compile(rf"^(?:{pat})\s*(.+)$", _I), op) for pat, op in
             [(r"not\s+(?:be\s+)?before|no\s+(?:earlier|sooner)\s+than|not\s+(?:be\s+)?earlier\s+than|on\s+or\s+after", ">="),
              (r"not\s+(?:be\s+)?after|no\s+later\s+than|not\s+(?:be\s+)?later\s+than|on\s+or\s+before", "<="),
              (r"later\s+than", ">"), (r"earlier\s+than", "<"),
              (r"(?:the\s+)?same\s+as|identical\s+to|match(?:es)?", "="), (r"not\s+(?:the\s+)?same\s+as", "<>"), *_OPS]]
_OPEN_BETWEEN = re.compile(r"^(?:between|in\s+the\s+range|in\s+range|from)\s+(.+?)\s+(?:and|to)\s+(.+?)(?:\s+inclusive)?$", _I)


def _side(text: str, cols: Columns):
    """One side of a comparison: a value or an operand with columns."""
    text = text.strip()
    if re.fullmatch(_VALUE, text, _I):
        return _value(text)
    tree = cols.operand(text)
    return None if tree is None else ("ref", tree)


def _parse_relation(core: str, cols: Columns) -> Spec | None:
    """A comparison with other columns."""
    m = SHIFT.match(core)
    base = m and cols.operand(m.group(5))
    if base:
        found = shifted(m.group(1), m.group(2), m.group(3), m.group(4), base)
        if found is None:
            raise RuleSyntaxError(f"rule not understood: {core!r}")
        op, bounds = found
        return Spec("between" if op == "between" else "cmp", op=op, values=tuple(("ref", b) for b in bounds))
    m = _OPEN_BETWEEN.match(core)
    if m:
        sides = tuple(_side(g, cols) for g in m.groups())
        if None not in sides:
            return Spec("between", values=sides)
    for pat, op in _OPEN_CMP:
        m = pat.match(core)
        tree = m and cols.operand(m.group(1))
        if tree:
            return Spec("cmp", op=op, values=(("ref", tree),))
    return None


# Text classes that may follow "contain" without quotes -> what a text with one of them matches.
_CLASSES = [
    (r"(?:any\s+)?special\s+(?:characters?|symbols?)", r"[^A-Za-z0-9\s]"),
    (r"(?:any\s+)?(?:white\s*spaces?|spaces?|blanks?)(?:\s+characters?)?", r"\s"),
    (r"(?:any\s+|a\s+|at\s+least\s+one\s+)?(?:digits?|numbers?|numeric\s+characters?)", r"[0-9]"),
    (r"(?:any\s+|a\s+|at\s+least\s+one\s+)?(?:letters?|alphabetic\s+characters?)", r"[A-Za-z]"),
    (r"(?:any\s+|an\s+|at\s+least\s+one\s+)?upper\s*case\s+(?:letters?|characters?)", r"[A-Z]"),
    (r"(?:any\s+|a\s+|at\s+least\s+one\s+)?lower\s*case\s+(?:letters?|characters?)", r"[a-z]"),
    (r"(?:any\s+)?punctuation(?:\s+(?:marks?|characters?))?", r"[!-/:-@\[-`{-~]"),
]
_ONLY = re.compile(r"^(?:only|just|nothing\s+but)\s+(.+)$", _I)
_ONLY_CLASSES = [(r"(?:digits?|numbers?|numeric\s+characters?)", "0-9"), (r"(?:letters?|alphabetic\s+characters?)", "A-Za-z"),
                 (r"upper\s*case\s+(?:letters?|characters?)", "A-Z"), (r"lower\s*case\s+(?:letters?|characters?)", "a-z"),
                 (r"alpha\s*numeric(?:\s+characters?)?", "A-Za-z0-9"), (r"(?:white\s*)?spaces?", r"\s"), (r"underscores?", "_"),
                 (r"(?:hyphens?|dashes)", r"\-"), (r"(?:dots|periods?)", r"\.")]


def _class_pattern(kind: str, text: str) -> str | None:
    """Pattern of a class of characters named without quotes."""
    only = _ONLY.match(text) if kind == "contains" else None
    if only:
        parts = re.split(r"\s*,\s*(?:and\s+)?|\s+(?:and|or)\s+", only.group(1).strip())
        found = [next((c for pat, c in _ONLY_CLASSES if re.fullmatch(pat, p, _I)), None) for p in parts]
        return None if None in found else f"^[{''.join(found)}]*$"
    found = next((c for pat, c in _CLASSES if re.fullmatch(pat, text, _I)), None)
    return found and {"contains": found, "starts": f"^(?:{found})", "ends": f"(?:{found})$"}[kind]


_LIST_ITEM = rf"(?:{_QUOTED}|[^\s,'\"]+)"
_WORD_LIST = re.compile(r"^((?:the\s+)?(?:(?:column|field)\s+)?(?:values?\s+|it\s+)?(?:(?:must|should|shall|has\s+to|needs\s+to|may|can)\s+)?"
                        rf"(?:always\s+)?(?:be|is|are)\s+)?(either\s+)?({_LIST_ITEM}(?:\s*,\s*{_LIST_ITEM})*\s*,?\s+or\s+{_LIST_ITEM})$", _I)


def _word_list(raw: str) -> Spec | None:
    """``should be A, B or C``, ``either A or B``: bare words, none of them a rule by itself."""
    m = _WORD_LIST.match(raw)
    if not m or not (m.group(1) or m.group(2)):
        return None
    values = []
    for item in re.findall(_LIST_ITEM, re.sub(r",?\s+or\s+(?=\S+$)", ", ", m.group(3), flags=_I)):
        if item[:1] not in "'\"":
            try:
                _parse_atom(item)
                return None
            except RuleSyntaxError:
                pass
        values.append(_value(item))
    return Spec("in", values=tuple(values))


_TABLE = r"(?:[A-Za-z_]\w*|`(?:[^`]|``)+`)"
_EXISTS = re.compile(r"^(?:exists?|(?:be\s+)?(?:present|found|listed|contained|defined)|references?|refers?\s+to|an?\s+(?:valid\s+)?"
                     r"(?:foreign\s+key|reference|key)|one\s+of\s+the\s+values|a\s+value)\s+(?:(?:in|to|into|of|from)\s+)?(?:the\s+)?"
                     rf"(?:(?:table|column)\s+)?(?:({_TABLE}(?:\.{_TABLE})+)|({_TABLE}(?:\.{_TABLE})*)\s*\(\s*({_TABLE})\s*\)|"
                     rf"({_TABLE})\s+(?:column\s+)?(?:of|in)\s+(?:the\s+)?(?:table\s+)?({_TABLE}(?:\.{_TABLE})*)(?:\s+table)?)$", _I)


def _parse_exists(core: str) -> Spec | None:
    """``must exist in customer.c_custkey``, ``references customer(c_custkey)``."""
    m = _EXISTS.match(core)
    if not m:
        return None
    names = re.findall(_TABLE, m.group(1) or m.group(2) or m.group(5))
    names = [n[1:-1].replace("``", "`") if n[:1] == "`" else n for n in names]
    if m.group(1):
        *names, column = names
    else:
        column = m.group(3) or m.group(4)
        column = column[1:-1].replace("``", "`") if column[:1] == "`" else column
    return Spec("exists", text=".".join(quote_ident(n) if not re.fullmatch(r"\w+", n) else n for n in names), values=(column,))


def _parse_atom(text: str, cols: Columns | None = None) -> Spec:
    """One rule without a top-level ``and``. Every pattern is anchored at both
    ends, so no part of the text can be left over."""
    raw = text.strip().rstrip(".")
    if not raw:
        raise RuleSyntaxError("empty rule")
    if _TRUE.match(raw):
        return Spec("true")
    if _NOT_NULL.match(raw):
        return Spec("not_null")
    core = _FILLER.sub("", raw, count=1).strip()
    if _NOT_NULL.match(core):
        return Spec("not_null")
    if _IS_NULL.match(core):
        return Spec("is_null")
    if _UNIQUE.match(core):
        return Spec("unique")
    m = _BOOL.match(core)
    if m:
        return Spec("bool", text=m.group(1).lower())
    if _INTEGER.match(core):
        return Spec("integer")
    m = _N_CHARS.match(core)
    if m:
        return Spec("len_cmp", op="=", values=(("num", m.group(1)),))
    if _EMAIL.match(core) or _EMAIL_SUBJECT.match(raw):
        return Spec("email")
    m = _IN_LIST.match(core)
    if m:
        values = parse_list(m.group(1))
        if not values:
            raise RuleSyntaxError(f"empty value list in {text!r}")
        return Spec("in", values=values)
    m = _BARE_ONE_OF.match(core) or _OR_LIST.match(core)
    if m:
        body = ", ".join(_split(m.group(1).strip(), "or"))
        values = parse_list(f"[{body}]")
        if values:
            return Spec("in", values=values)
    m = _ALLOWED.match(core)
    if m:
        body = m.group(1).strip()
        values = parse_list(body if body[:1] in "[({" else f"[{body}]")
        if not values:
            raise RuleSyntaxError(f"empty value list in {text!r}")
        return Spec("in", values=values)
    if _NUMBER.match(core):
        return Spec("number")
    m = _VALID_TYPE.match(core)
    if m:
        return Spec("castable", text=normalize_type(m.group(1)))
    m = _FORMAT.match(core)
    if m:
        return Spec("format", text=_phrase(m.group(2)))
    if _NOT_EMPTY.match(core):
        return Spec("not_empty")
    m = _TIME.match(core)
    if m:
        past = (m.group(1) or "").lower() == "past" or (m.group(2) or "").lower() == "future"
        return Spec("cmp_now", op="<=" if past else ">")
    m = _SHAPE.match(core)
    if m:
        word = re.sub(r"\s+", " ", m.group(1).lower())
        shape = ("upper" if word.startswith("upper") else "lower" if word.startswith("lower")
                 else "alnum" if word.startswith("alpha") else "url" if word.endswith("url") else "digits")
        return Spec("shape", text=shape)
    m = _REGEX.match(core)
    if m:
        return Spec("regex", text=_phrase(m.group(1)))
    m = _AFFIX.match(core)
    if m:
        kind = "contains" if m.group(3) else "starts" if m.group(1).lower() in ("start", "begin") else "ends"
        what = (m.group(2) or m.group(4)).strip()
        if re.fullmatch(_QUOTED, what, re.S):
            return Spec(kind, text=_unquote(what))
        pattern = _class_pattern(kind, what)
        if pattern is None:
            raise RuleSyntaxError(f"quote the text {what!r} (without quotes only classes such as 'special characters' are understood)")
        return Spec("regex", text=pattern)
    m = _parse_exists(core) or _parse_exists(raw)
    if m:
        return m
    m = _LEN_PREFIX.match(core)
    if m:
        inner = _LEN_SUFFIX.sub(r"\1", m.group(1).strip())
        spec = _parse_cmp(inner) or (_parse_cmp("= " + inner) if is_number(inner) else None)  # lengths: constants only
        if spec:
            return Spec("len_" + spec.kind, op=spec.op, values=spec.values)
    m = _LEN_PREFIX2.match(core)
    if m:
        op = ">=" if m.group(1).lower().startswith("min") else "<="
        val = _LEN_SUFFIX.sub(r"\1", m.group(2).strip())
        if is_number(val):
            return Spec("len_cmp", op=op, values=(("num", val),))
    m = _LEN_SUFFIX.match(core)
    if m:
        spec = _parse_cmp(m.group(1).strip())
        if spec:
            return Spec("len_" + spec.kind, op=spec.op, values=spec.values)
    spec = _parse_cmp(core, cols)
    if spec:
        return spec
    if re.fullmatch(_QUOTED, core, re.S):
        return Spec("in", values=(_value(core),))
    m = _NOT.match(core)
    if m:
        inner = _parse_atom(m.group(1), cols)
        if inner.kind in ("unique", "true"):
            raise RuleSyntaxError(f"rule not understood: {text!r}")
        return Spec("not", parts=(inner,))
    spec = _word_list(raw)
    if spec:
        return spec
    raise RuleSyntaxError(f"rule not understood: {text!r}")


_SUBJECT = re.compile(r"^[A-Za-z_][\w]*\s+(?=(?:must|should|shall|cannot|can|has\s+to|needs\s+to|will|is|are)\b)", _I)


def parse_rule(text: str, columns: dict[str, str] | Columns | None = None) -> Spec:
    """Rule text -> ``Spec`` tree. ``sql: <expr>`` passes an expression verbatim.
    ``columns`` (name -> type) makes other columns of the frame known. A
    leading subject word ("Age must be ...") that is no column is dropped
    when the text does not parse with it."""
    if text is None or not str(text).strip():
        raise RuleSyntaxError("empty rule")
    text = str(text).strip()
    cols = columns if isinstance(columns, Columns) or columns is None else Columns(columns)
    try:
        return _parse_rule(text, cols)
    except RuleSyntaxError:
        stripped = _SUBJECT.sub("", text, count=1)
        if stripped == text or (cols is not None and _leading(text, cols)):  # a column is never taken for filler
            raise
        return _parse_rule(stripped, cols)


def _parse_rule(text: str, cols: Columns | None = None) -> Spec:
    m = _SQL.match(text)
    if m:
        return Spec("sql", text=m.group(1).strip())
    text = _squeeze(_CONTRACTED.sub(lambda m: m.group(2) or (m.group(1) or "can") + " not", text))
    return (_parse_conditional(text, cols) if cols is not None else None) or _parse_or(text, cols)


# --- conditions ---------------------------------------------------------------

_IF_FIRST = re.compile(r"^(?:if|when|whenever|where)\s+(.+)$", _I | re.S)
_THEN = re.compile(r",?\s+then\s+", _I)
_COMMA = re.compile(r",\s+")
_IF_LAST = re.compile(r"(,?\s+)(only\s+)?(if|when|whenever|unless)\s+", _I)
_ELSE = re.compile(r"[,;]?\s+(?:else|otherwise),?\s+", _I)
_EQUALS_WORD = re.compile(rf"^(?:is|are|was|equals?|=|==)\s+(not\s+)?(?:equal\s+to\s+)?({_QUOTED}|[\w.+-]+)$", _I)
_IS_SET = re.compile(r"^(?:is|are)\s+(not\s+)?(?:present|given|set|filled|provided|populated|known|available|specified)$", _I)
_MODAL_VERB = re.compile(r"^(?:must|should|shall|can|may|cannot|has|have|needs?|is|are|will|equals?|=|<|>|!|between|in)(?=\W|\s|$)", _I)


def _outside(text: str) -> list[bool]:
    """Per character: outside quotes and brackets."""
    out, depth, quote, i = [], 0, None, 0
    while i < len(text):
        ch = text[i]
        if quote:
            out.append(False)
            if ch == "\\" and i + 1 < len(text):
                out.append(False)
                i += 1
            elif ch == quote:
                quote = None
        elif ch in "'\"`" and (ch == "`" or i == 0 or not text[i - 1].isalnum()):
            quote = ch
            out.append(False)
        else:
            depth += (ch in "[({") - (ch in "])}")
            out.append(depth == 0)
        i += 1
    return out


def _cuts(text: str, pattern: re.Pattern):
    """Matches of ``pattern`` outside quotes and brackets."""
    free = _outside(text)
    return [m for m in pattern.finditer(text) if all(free[m.start():m.end()])]


def _parse_conditional(text: str, cols: Columns) -> Spec | None:
    """``if C then R [else S]``, ``when C, R``, ``R if C``, ``R unless C``."""
    m = _IF_FIRST.match(text)
    if m:
        body, tried = m.group(1).rstrip("."), None
        for cut in _cuts(body, _THEN)[:1] or _cuts(body, _COMMA):
            try:
                condition, rest = _parse_condition(body[:cut.start()], cols), body[cut.end():]
                other = _cuts(rest, _ELSE)[:1]
                rules = [rest] if not other else [rest[:other[0].start()], rest[other[0].end():]]
                return _conditional("if", condition, [_parse_or(r, cols) for r in rules])
            except RuleSyntaxError as e:
                tried = e
        raise tried or RuleSyntaxError(f"condition without a rule: {text!r}")
    for cut in _cuts(text, _IF_LAST):
        if cut.group(2):
            raise RuleSyntaxError(f"'only {cut.group(3)}' is ambiguous; write 'if <condition> then <rule>'")
        kind = "unless" if cut.group(3).lower() == "unless" else "if"
        return _conditional(kind, _parse_condition(text[cut.end():].rstrip("."), cols), [_parse_or(text[:cut.start()], cols)])
    return None


def _conditional(kind: str, condition: Spec, rules: list[Spec]) -> Spec:
    if any(has_unique(s) for s in (condition, *rules)):
        raise RuleSyntaxError("uniqueness is a rule of the whole column and cannot depend on a condition")
    return Spec(kind, parts=(condition, *rules))


def _parse_condition(text: str, cols: Columns, subject: str | None = None) -> Spec:
    """``status is 'A' and amount is greater than 5``: rules on named columns;
    a part that names none is about the column named before it."""
    ors = _split(text.strip(), "or", cols)
    if len(ors) > 1:
        parts = []
        for p in ors:
            parts.append(_parse_condition(p, cols, subject))
            subject = _last_subject(parts[-1])
        return Spec("or", parts=tuple(parts))
    parts = []
    for p in _split(text.strip(), "and", cols):
        own = _SELF.match(p)
        found = None if own else cols.leading(p)
        name, rest = found if found else ("", p[own.end():]) if own else (subject, p)
        if name is None:
            raise RuleSyntaxError(f"a condition must start with a column: {p!r}")
        subject = name
        state = _parse_state(rest.strip(), cols)
        parts.append(Spec("on", text=name, parts=(state,)) if name else state)
    return parts[0] if len(parts) == 1 else Spec("and", parts=tuple(parts))


_SELF = re.compile(r"^(?:the\s+)?(?:value|it)\s+(?=is\b|has\b|=|<|>)", _I)  # the rule's own column


def _last_subject(spec: Spec) -> str:
    return spec.text if spec.kind == "on" else _last_subject(spec.parts[-1]) if spec.kind in ("and", "or") else ""


def _parse_state(text: str, cols: Columns) -> Spec:
    """What a condition says of its column."""
    m = _IS_SET.match(text)
    if m:
        return Spec("is_null" if m.group(1) else "not_null")
    m = _EQUALS_WORD.match(text)
    if m and not (m.group(2)[:1] in "'\"" or is_number(m.group(2))):
        try:  # "is null", "is positive": a rule; any other single word is a value
            return _parse_or(text, cols)
        except RuleSyntaxError:
            pass
    if m:
        same = Spec("in", values=(_value(m.group(2)),))
        return Spec("not", parts=(same,)) if m.group(1) else same
    return _parse_or(text, cols)


_OWN = re.compile(r"^(?:the\s+)?(?:values?|it|column|field|length|size)\b(?!\s+(?:of|in)\b)", _I)


def _leading(text: str, cols: Columns) -> tuple[str, str] | None:
    """A column as the subject of a rule. "Value", "it", "length" and the like
    speak of the rule's own column, whatever the frame's columns are called."""
    found = None if _OWN.match(text) else cols.leading(text)
    return found if found and _MODAL_VERB.match(found[1]) else None


_MODAL = re.compile(r"^(?:the\s+)?(?:values?\s+|it\s+)?(?:must|should|shall|can|may|not|is|are|has|needs)\b", _I)
_NEVER = re.compile(r"^(?:(?:the\s+)?(?:values?\s+|it\s+)?(?:must|should|shall|can|may)\s+)?not\s+"
                    r"(?:be\s+(?:an?\s+)?|(?=(?:null|empty|blank|missing)$))", _I)
_LEAD = re.compile(r"^((?:should|must|shall)\s+(?:not\s+)?be\s+(?:an?\s+)?)", _I)


def _parse_or(text: str, cols: Columns | None = None) -> Spec:
    """``and`` binds tighter than ``or``; a text without ``and`` may be one rule
    that holds an ``or`` itself ("'Y' or 'N'", "one of A, B or C")."""
    subject = _leading(text, cols) if cols is not None else None
    if subject:  # "status must be 'A' or 'B'": all of it is about that column, up to the next subject
        return Spec("on", text=subject[0], parts=(_parse_or(subject[1], cols),))
    ors = _split(text, "or", cols)
    if len(ors) == 1:
        return _parse_and(text, cols)
    if len(_split(text, "and", cols)) == 1:
        try:
            return _parse_atom(text, cols)
        except RuleSyntaxError:
            pass
    never = _NEVER.match(ors[0])
    if never and not any(_MODAL.match(p) for p in ors[1:]):  # "must not be X or Y" is neither of them
        return Spec("and", parts=tuple(_parse_and(p if i == 0 else never.group(0) + p, cols) for i, p in enumerate(ors)))
    ors[0] = re.sub(r"^either\s+", "", ors[0], flags=_I)
    try:
        return Spec("or", parts=_with_lead(ors, lambda p: _parse_and(p, cols)))
    except RuleSyntaxError:
        if len(_split(text, "and", cols)) == 1:
            raise
        return _parse_and(text, cols)  # the "or" is inside a part: "'Y' or 'N' and not null"


def _parse_and(text: str, cols: Columns | None = None) -> Spec:
    def part(p):
        subject = _leading(p, cols) if cols is not None else None
        return Spec("on", text=subject[0], parts=(_parse_atom(subject[1], cols),)) if subject else _parse_atom(p, cols)
    parts = _split(text, "and", cols)
    if len(parts) == 1:
        return part(text)
    return Spec("and", parts=_with_lead(parts, part))


def _with_lead(parts: list[str], parse) -> tuple:
    """Parsed parts; a part that is no rule by itself shares the first one's "should be a"."""
    lead = _LEAD.match(parts[0])
    out = []
    for part in parts:
        try:
            out.append(parse(part))
        except RuleSyntaxError:
            if not lead or part is parts[0]:
                raise
            out.append(parse(lead.group(1) + part))
    return tuple(out)


#: Stands in an expression for the flag column of a uniqueness part.
UNIQUE_REF = "`__rg_unique_flag`"


def has_unique(spec: Spec) -> bool:
    """True when the rule is, or holds, a uniqueness part."""
    return spec.kind == "unique" or any(has_unique(p) for p in spec.parts)


def exists_parts(spec: Spec, column: str) -> list[tuple[str, str, str]]:
    """(column, table, reference column) of every "must exist in" of a rule on ``column``."""
    if spec.kind == "exists":
        return [(column, spec.text, spec.values[0])]
    inner = spec.text if spec.kind == "on" else column
    return [x for p in spec.parts for x in exists_parts(p, inner)]


def exists_ref(col_sql: str, table: str, reference: str) -> str:
    """Stands in an expression for the flag column of an existence part."""
    return quote_ident(f"__rg_exists {col_sql} {table} {reference}")


# --------------------------------------------------------------------------- #
# Spec -> SQL


def _lit(value: tuple, data_type: str) -> str:
    """Literal of the comparison type. A value that cannot take that type
    becomes NULL (``TRY_CAST``), so the check is NULL for every row instead
    of failing the query under ANSI casts."""
    kind, text = value
    if is_string_type(data_type):
        return quote_str(text)
    if is_numeric_type(data_type) and is_number(text):
        return text
    return f"TRY_CAST({quote_str(text)} AS {normalize_type(data_type).upper()})"


def _typed(col_sql: str, col_type: str | None, data_type: str, values: tuple) -> str:
    """Column as the rule's type: ``TRY_CAST`` only when the types differ, so
    an uncastable value yields NULL (left to the type check) instead of an
    ANSI cast error."""
    target = normalize_type(data_type)
    if is_string_type(target) and values and all(v[0] == "num" for v in values):
        target = "double"
    if col_type is not None and normalize_type(col_type) == target:
        return col_sql
    if col_type is None and target == normalize_type(data_type):
        return col_sql
    return f"TRY_CAST({col_sql} AS {target.upper()})"


def _as_string(col_sql: str, col_type: str | None) -> str:
    if col_type is None or is_string_type(col_type):
        return col_sql
    return f"CAST({col_sql} AS STRING)"


def _guard(col_sql: str, cond: str) -> str:
    return f"({col_sql} IS NULL) OR ({cond})"


def _compared(spec: Spec, col_sql: str, data_type: str, col_type: str | None, types: dict[str, str]) -> tuple[str, list[str]]:
    """The column and the right sides of a comparison, in one type."""
    trees = [v[1] for v in spec.values if v[0] == "ref"]
    if not trees:
        typed = _typed(col_sql, col_type, data_type, spec.values)
        target = "double" if typed.endswith("AS DOUBLE)") else data_type
        return typed, [_lit(v, target) for v in spec.values]
    target = normalize_type(data_type)
    for tree in trees:
        target = operand_type(tree, target, types)
    if is_time_type(target) and col_type is not None and is_time_type(col_type) and not is_time_type(data_type):
        target = normalize_type(col_type)
    typed = col_sql if col_type is not None and normalize_type(col_type) == normalize_type(target) else f"TRY_CAST({col_sql} AS {target.upper()})"
    return typed, [operand_sql(v[1], target, types) if v[0] == "ref" else _lit(v, target) for v in spec.values]


def _condition_sql(spec: Spec, col_sql: str, data_type: str, col_type: str | None, now: str, types: dict[str, str]) -> str:
    """A condition with three values: NULL when it is about a NULL."""
    if spec.kind in ("and", "or"):
        return f" {spec.kind.upper()} ".join(f"({_condition_sql(p, col_sql, data_type, col_type, now, types)})" for p in spec.parts)
    if spec.kind == "on":
        c, t = quote_ident(spec.text), types.get(spec.text)
        return _condition_sql(spec.parts[0], c, t or "string", t, now, types)
    text = to_sql(spec, col_sql, data_type, col_type, now, types)
    return text if spec.kind in ("is_null", "not_null", "true") else f"CASE WHEN {col_sql} IS NOT NULL THEN ({text}) END"


def to_sql(spec: Spec, col_sql: str, data_type: str, col_type: str | None = None, now: str = "current_timestamp()",
           types: dict[str, str] | None = None) -> str | None:
    """SQL text of one rule. Returns ``None`` for ``unique`` (a plan-level
    check; inside a compound it is ``UNIQUE_REF``) and ``"true"`` for rules
    that hold for every row. ``now`` is what time rules compare with, ``types``
    the types of the frame's columns for rules that name others."""
    k, types = spec.kind, types or {}
    if k in ("if", "unless"):
        condition = _condition_sql(spec.parts[0], col_sql, data_type, col_type, now, types)
        rules = [to_sql(p, col_sql, data_type, col_type, now, types) for p in spec.parts[1:]]
        if k == "unless":
            return f"CASE WHEN {condition} THEN true ELSE ({rules[0]}) END"
        other = f" WHEN NOT ({condition}) THEN ({rules[1]})" if len(rules) > 1 else ""
        return f"CASE WHEN {condition} THEN ({rules[0]}){other} ELSE true END"
    if k == "on":
        c = quote_ident(spec.text)
        t = types.get(spec.text)
        if c == col_sql:
            return to_sql(spec.parts[0], col_sql, data_type, col_type, now, types)
        if has_unique(spec):
            raise RuleSyntaxError("uniqueness of another column needs a rule of its own")
        return to_sql(spec.parts[0], c, t or "string", t, now, types)
    if k == "exists":
        return _guard(col_sql, exists_ref(col_sql, spec.text, spec.values[0]))
    if k == "true":
        return "true"
    if k == "not_null":
        return f"{col_sql} IS NOT NULL"
    if k == "unique":
        return None
    if k == "sql":
        return spec.text
    if k == "email":
        return _guard(col_sql, f"{_as_string(col_sql, col_type)} RLIKE {quote_str(EMAIL_REGEX)}")
    if k == "regex":
        return _guard(col_sql, f"{_as_string(col_sql, col_type)} RLIKE {quote_str(spec.text)}")
    if k == "not_empty":
        return _guard(col_sql, f"TRIM({_as_string(col_sql, col_type)}) <> ''")
    if k in ("starts", "ends", "contains"):
        fn = {"starts": "startswith", "ends": "endswith", "contains": "contains"}[k]
        return _guard(col_sql, f"{fn}({_as_string(col_sql, col_type)}, {quote_str(spec.text)})")
    if k == "is_null":
        return f"{col_sql} IS NULL"
    if k == "castable":
        target = spec.text
        if normalize_type(data_type) == target or (col_type is not None and normalize_type(col_type) == target):
            return "true"
        return _guard(col_sql, f"TRY_CAST({_as_string(col_sql, col_type)} AS {target.upper()}) IS NOT NULL")
    if k == "format":
        return _guard(col_sql, f"try_to_timestamp({_as_string(col_sql, col_type)}, {quote_str(spec.text)}) IS NOT NULL")
    if k == "cmp_now":
        direct = col_type is not None and normalize_type(col_type) in ("timestamp", "timestamp_ltz")
        ts = col_sql if direct else f"TRY_CAST({_as_string(col_sql, col_type)} AS TIMESTAMP)"
        return _guard(col_sql, f"{ts} {spec.op} {now}")
    if k == "bool":
        direct = col_type is not None and normalize_type(col_type) == "boolean"
        return _guard(col_sql, f"{col_sql if direct else f'TRY_CAST({col_sql} AS BOOLEAN)'} = {spec.text}")
    if k == "integer":
        if (normalize_type(col_type) if col_type is not None else normalize_type(data_type)) in (
                "tinyint", "smallint", "int", "bigint"):
            return "true"
        num = f"TRY_CAST({_as_string(col_sql, col_type)} AS DOUBLE)"
        return _guard(col_sql, f"coalesce({num} = floor({num}), false)")
    if k == "not":
        inner = to_sql(spec.parts[0], col_sql, data_type, col_type, now, types)
        return _guard(col_sql, f"NOT ({inner})")
    if k == "shape":
        c = _as_string(col_sql, col_type)
        cond = {"upper": f"{c} = upper({c})", "lower": f"{c} = lower({c})",
                "alnum": f"{c} RLIKE '^[A-Za-z0-9]*$'", "digits": f"{c} RLIKE '^[0-9]+$'",
                "url": f"{c} RLIKE '^https?://[^\\s/$.?#][^\\s]*$'"}[spec.text]
        return _guard(col_sql, cond)
    if k == "number":
        if is_numeric_type(data_type):
            return "true"
        # via the text form: castable from any atomic type
        return _guard(col_sql, f"TRY_CAST({_as_string(col_sql, col_type)} AS DOUBLE) IS NOT NULL")
    if k == "in":
        # a string column is compared as strings, so codes such as 01 keep their zeros
        text_values = tuple(("str", v[1]) for v in spec.values) if is_string_type(data_type) else spec.values
        typed = _typed(col_sql, col_type, data_type, text_values)
        target = data_type
        vals = ", ".join(_lit(v, target) for v in spec.values)
        return _guard(col_sql, f"{typed} IN ({vals})")
    if k == "cmp":
        typed, sides = _compared(spec, col_sql, data_type, col_type, types)
        return _guard(col_sql, f"{typed} {spec.op} {sides[0]}")
    if k == "between":
        typed, (lo, hi) = _compared(spec, col_sql, data_type, col_type, types)
        return _guard(col_sql, f"{typed} BETWEEN {lo} AND {hi}")
    if k == "len_cmp":
        return _guard(col_sql, f"length({_as_string(col_sql, col_type)}) {spec.op} {spec.values[0][1]}")
    if k == "len_between":
        lo, hi = (v[1] for v in spec.values)
        return _guard(col_sql, f"length({_as_string(col_sql, col_type)}) BETWEEN {lo} AND {hi}")
    if k in ("and", "or"):
        texts = [to_sql(p, col_sql, data_type, col_type, now, types) for p in spec.parts]
        texts = [UNIQUE_REF if t is None else t for t in texts]
        if k == "or":
            return "true" if "true" in texts else " OR ".join(f"({t})" for t in texts)
        kept = [t for t in texts if t != "true"]
        if not kept:
            return "true"
        if len(kept) == 1:
            return kept[0]
        return " AND ".join(f"({t})" for t in kept)
    raise RuleSyntaxError(f"unknown rule kind {k}")


def format_value_list(values) -> str:
    """``['A', 'B']`` text for an in-list rule, read back by ``parse_list``:
    quotes doubled SQL-style, backslashes escaped."""
    return "[" + ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "''") + "'" for v in values) + "]"


__all__ = ["Spec", "RuleSyntaxError", "Columns", "parse_rule", "to_sql", "has_unique", "exists_parts", "exists_ref", "parse_list", "format_value_list"]
