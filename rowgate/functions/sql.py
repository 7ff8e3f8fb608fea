"""Quoting helpers for Spark SQL text built from rule tables."""

from __future__ import annotations

import re


def quote_ident(name: str) -> str:
    """Back-quote a column name for Spark SQL (`a``b`)."""
    return "`" + name.replace("`", "``") + "`"


def quote_str(value: str) -> str:
    """Spark SQL string literal; backslashes and quotes are escaped so the
    literal keeps its exact value (regex dots stay escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NUMBER = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def is_number(text: str) -> bool:
    return bool(_NUMBER.match(text.strip()))


#: String literals, quoted names, comments, words, anything else: one token each.
_SQL_TOKEN = re.compile(r"""(?P<text>r?'(?:[^'\\]|\\.|'')*'|r?"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)"""
                        r"""|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<word>[A-Za-z_]\w*)|(?P<space>\s+)|(?P<other>.)""", re.S)

#: Functions of the current time -> the same as an expression of one moment.
_TIME_CALLS = {
    "current_timestamp": "{now}",
    "now": "{now}",
    "current_date": "CAST({now} AS DATE)",
    "curdate": "CAST({now} AS DATE)",
    "localtimestamp": "CAST({now} AS TIMESTAMP_NTZ)",
    "unix_timestamp": "unix_timestamp({now})",
}
_WITHOUT_BRACKETS = {"current_timestamp", "current_date", "localtimestamp"}  # SQL allows them as bare words


def bind_time(sql: str, now: str, columns=()) -> str:
    """``sql`` with every call for the current time replaced by ``now`` (an SQL
    literal). Text in quotes and comments, names in back-quotes, fields
    (``a.now``) and bare words that name a column stay as they are."""
    tokens = [(m.lastgroup, m.group()) for m in _SQL_TOKEN.finditer(sql)]
    known = {c.lower() for c in columns}
    solid = [i for i, (kind, _) in enumerate(tokens) if kind not in ("space", "comment")]
    place = {i: n for n, i in enumerate(solid)}

    def near(i: int, by: int) -> str:
        n = place[i] + by
        return tokens[solid[n]][1] if 0 <= n < len(solid) else ""
    out, skip = [], -1
    for i, (kind, text) in enumerate(tokens):
        if i <= skip:
            continue
        call = _TIME_CALLS.get(text.lower()) if kind == "word" else None
        if call is None or near(i, -1) == "." or near(i, 1) == ".":
            out.append(text)
        elif near(i, 1) == "(" and near(i, 2) == ")":
            out.append(call.format(now=now))
            skip = solid[place[i] + 2]
        elif near(i, 1) != "(" and text.lower() in _WITHOUT_BRACKETS and text.lower() not in known:
            out.append(call.format(now=now))
        else:
            out.append(text)
    return "".join(out)
