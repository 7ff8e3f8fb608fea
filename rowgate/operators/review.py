"""Source review (G2-G7): deterministic checks of notebook/source text.

Input is a table of files ``(path, text)``, one row per file. Each file's
text is split into its array of lines inside the row, flagged with cheap
literal tests and regexes, and reduced to counts, first line number and
first offending line with higher-order functions: a map-only job with no
shuffle and no sort, so it scales with the number of files and never moves
lines between tasks. The report has one row per file and standard with a
PASS/FAIL verdict, the number of offending lines, and all of them as
evidence (``array<struct<line_no, line>>``).

Whether a read or write is guarded follows from the blocks of the file: a
fold over its lines keeps the stack of ``try:`` lines whose block is open
(those with less indentation than every line since), so ``except`` and
``finally`` blocks, other functions and code after the block do not count as
guarded. Blank lines and comments neither open nor close a block and hold no
read or write; a tab counts as 8 columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sql import quote_ident, quote_str

# --- fixed values: the five coding standards, in their documented order ----
STANDARDS = ("secrets", "parameters", "documentation", "performance", "error_handling")

# Explanation per standard: (when failing, when passing).
EXPLANATIONS = {
    "secrets": ("hard-coded secret at line {line}; read it with dbutils.secrets.get", "no hard-coded secret"),
    "parameters": ("literal storage path at line {line}; take it from dbutils.widgets.get",
                   "no literal storage path"),
    "documentation": ("needs # MAGIC %md cells and # comments", "markdown cells and comments present"),
    "performance": ("collect/display/toPandas on a full frame at line {line}; add .limit(n)",
                    "no unbounded collect or display"),
    "error_handling": ("read or write at line {line} outside try/except", "reads and writes are guarded"),
}

# Patterns (Java regex and RE2 agree on all of them).
SECRET_RE = r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key)\s*[:=]\s*[\"'][^\"']+"
LITERAL_PATH_RE = r"[\"'](/(dbfs|mnt|Volumes|tmp|data|user|home)/|dbfs:/|s3a?://|abfss?://|gs://|wasbs?://|file:/)"
MARKDOWN_RE = r"^\s*# MAGIC %md"
COMMENT_RE = r"^\s*#"
NOT_COMMENT_RE = r"^\s*# (MAGIC|COMMAND|Databricks notebook source)"
ACTION_RE = r"\.collect\(\)|(^|[^A-Za-z0-9_.])display\(|\.toPandas\(\)"
LIMITED_RE = r"\.limit\(|\.take\(|\.head\("
IO_RE = r"spark\.read|\.write\.|\.save\(|\.saveAsTable\(|spark\.table\(|\.load\(|\.insertInto\("
TRY_RE = r"^\s*try\s*:"
NO_CODE_RE = r"^\s*(#|$)"


def source_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, line_no, line)``: every line of every file, numbered from 1."""
    return (files.selectExpr(f"{quote_ident(path)} AS path",
                             f"posexplode(split({quote_ident(text)}, '\\n', -1)) AS (pos, line)")
            .selectExpr("path", "CAST(pos + 1 AS INT) AS line_no", "line"))


# Literal substrings each pattern needs: a cheap ``contains`` test runs first
# and the regex only on lines that pass it (same result, far less regex work).
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key")
ACTION_WORDS = (".collect()", "display(", ".toPandas()")
IO_WORDS = ("spark.read", ".write.", ".save(", ".saveAsTable(", "spark.table(", ".load(", ".insertInto(")

FLAGS = ("secret", "literal_path", "markdown", "comment", "full_action")
BLOCK_FLAG = "unguarded_io"  # needs the lines before


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {quote_str(w)})" for w in words) + ")"


def _rx(pattern: str, var: str = "line") -> str:
    return f"{var} RLIKE {quote_str(pattern)}"


def flag_sql(var: str = "line") -> dict[str, str]:
    """Per-line flags as SQL text over the line ``var`` (a column or a lambda
    variable), one boolean expression per flag."""
    return {
        "secret": f"(contains({var}, '=') OR contains({var}, ':')) AND {_any(f'lower({var})', SECRET_WORDS)} "
                  f"AND {_rx(SECRET_RE, var)}",
        "literal_path": f"(contains({var}, '\"') OR contains({var}, '\\'')) AND contains({var}, '/') "
                        f"AND {_rx(LITERAL_PATH_RE, var)}",
        "markdown": f"contains({var}, '# MAGIC %md') AND {_rx(MARKDOWN_RE, var)}",
        "comment": f"contains({var}, '#') AND {_rx(COMMENT_RE, var)} AND NOT {_rx(NOT_COMMENT_RE, var)}",
        "full_action": f"{_any(var, ACTION_WORDS)} AND {_rx(ACTION_RE, var)} AND NOT {_rx(LIMITED_RE, var)}",
    }


def unguarded_io_sql(lines: str = "lines") -> str:
    """Positions (from 0) of the lines that read or write outside the block of
    any ``try:``, as SQL over the array column ``lines``: one pass, whose state
    is the stack of the indentations of open ``try:`` lines and the hits."""
    lead = "left(l, length(l) - length(ltrim(' \t', l)))"
    code = (f"filter(transform({lines}, (l, i) -> named_struct('i', i, 'code', NOT {_rx(NO_CODE_RE, 'l')}, "
            f"'d', length({lead}) + 7 * (length({lead}) - length(replace({lead}, '\t', ''))), "
            f"'t', contains(l, 'try') AND {_rx(TRY_RE, 'l')}, 'io', {_any('l', IO_WORDS)})), x -> x.code)")
    return (f"aggregate({code}, named_struct('open', CAST(array() AS ARRAY<INT>), 'hits', CAST(array() AS ARRAY<INT>)), "
            "(a, x) -> named_struct("
            "'open', concat(filter(a.open, d -> d < x.d), IF(x.t, array(x.d), CAST(array() AS ARRAY<INT>))), "
            "'hits', IF(x.io AND NOT x.t AND NOT exists(a.open, d -> d < x.d), concat(a.hits, array(x.i)), a.hits)), a -> a.hits)")


def flag_lines(lines: DataFrame) -> DataFrame:
    return lines.selectExpr("path", "line_no", "line", *[f"{e} AS is_{k}" for k, e in flag_sql().items()])


def secret_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """G2 findings: ``(path, line_no, line)`` of lines with a hard-coded secret."""
    return source_lines(files, path, text).where(flag_sql()["secret"])


def _doc_guards(var: str) -> dict[str, str]:
    """Per flag, literal prerequisites tested once on the whole text: when a
    document fails its guard no line can be flagged, so the per-line pass is
    skipped (same result, less work)."""
    return {
        "secret": f"(contains({var}, '=') OR contains({var}, ':')) AND {_any(f'lower({var})', SECRET_WORDS)}",
        "literal_path": f"(contains({var}, '\"') OR contains({var}, '\\'')) AND contains({var}, '/')",
        "markdown": f"contains({var}, '# MAGIC %md')",
        "comment": f"contains({var}, '#')",
        "full_action": _any(var, ACTION_WORDS),
        BLOCK_FLAG: _any(var, IO_WORDS),
    }


NO_EVIDENCE = "CAST(array() AS ARRAY<STRUCT<line_no: INT, line: STRING>>)"


def file_stats(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Per file (one row each): number of flagged lines, first flagged line
    number and all flagged lines (bounded by the file). Computed inside the row over its array of lines
    (``transform`` / ``filter`` / ``array_position``): a map-only job, no
    explode, no sort, no shuffle, however large the table."""
    flags, guards = flag_sql("l"), _doc_guards("text")
    arrays = files.selectExpr(f"{quote_ident(path)} AS path", f"{quote_ident(text)} AS text",
                              f"split({quote_ident(text)}, '\\n', -1) AS lines")
    arrays = arrays.selectExpr("path", "lines", *[f"CASE WHEN {guards[k]} THEN transform(lines, l -> {flags[k]}) "
                                                  f"END AS f_{k}" for k in FLAGS],
                               f"CASE WHEN {guards[BLOCK_FLAG]} THEN {unguarded_io_sql()} END AS at_{BLOCK_FLAG}")
    stats = []
    for k in FLAGS:
        stats += [f"coalesce(size(filter(f_{k}, x -> x)), 0) AS n_{k}",
                  f"CAST(nullif(array_position(f_{k}, true), 0) AS INT) AS l_{k}",
                  f"coalesce(filter(transform(lines, (l, i) -> IF(f_{k}[i], named_struct('line_no', i + 1, 'line', l), NULL)), "
                  f"x -> x IS NOT NULL), {NO_EVIDENCE}) AS e_{k}"]
    k = BLOCK_FLAG
    stats += [f"coalesce(size(at_{k}), 0) AS n_{k}", f"CAST(element_at(at_{k}, IF(size(at_{k}) > 0, 1, NULL)) + 1 AS INT) AS l_{k}",
              f"coalesce(transform(at_{k}, i -> named_struct('line_no', i + 1, 'line', lines[i])), {NO_EVIDENCE}) AS e_{k}"]
    return arrays.selectExpr("path", *stats)


def _report_row(std: str, fail: str, hits: str, first_line: str, evidence: str) -> str:
    fail_text, pass_text = EXPLANATIONS[std]
    head, _, tail = fail_text.partition("{line}")
    fail_expl = (f"concat({quote_str(head)}, coalesce(CAST({first_line} AS STRING), '?'), {quote_str(tail)})"
                 if "{line}" in fail_text else quote_str(fail_text))
    return (f"named_struct('standard', {quote_str(std)}, "
            f"'verdict', CASE WHEN {fail} THEN 'FAIL' ELSE 'PASS' END, "
            f"'hits', CAST({hits} AS BIGINT), 'first_line', CAST({first_line} AS INT), "
            f"'evidence', {evidence}, "
            f"'explanation', CASE WHEN {fail} THEN {fail_expl} ELSE {quote_str(pass_text)} END)")


def review_sources(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, standard, verdict, hits, first_line, evidence, explanation)``.

    secrets         FAIL when a line assigns a quoted literal to a password/token/key name
    parameters      FAIL when a line holds a literal storage path (use widgets instead)
    documentation   PASS only with a ``# MAGIC %md`` cell and a ``#`` comment
    performance     FAIL on ``.collect()``/``display()``/``.toPandas()`` without ``.limit``/``take``/``head``
    error_handling  FAIL when a read or write sits outside the block of every ``try:``
    """
    rows = [
        _report_row("secrets", "n_secret > 0", "n_secret", "l_secret", "e_secret"),
        _report_row("parameters", "n_literal_path > 0", "n_literal_path", "l_literal_path", "e_literal_path"),
        _report_row("documentation", "NOT (n_markdown > 0 AND n_comment > 0)", "n_markdown + n_comment",
                    "NULL", NO_EVIDENCE),
        _report_row("performance", "n_full_action > 0", "n_full_action", "l_full_action", "e_full_action"),
        _report_row("error_handling", "n_unguarded_io > 0", "n_unguarded_io", "l_unguarded_io", "e_unguarded_io"),
    ]
    return file_stats(files, path, text).selectExpr("path", f"inline(array({', '.join(rows)}))")
