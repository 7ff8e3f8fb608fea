import pytest

from rowgate.functions.fixed import EMAIL_REGEX
from rowgate.functions.grammar import (
    UNIQUE_REF,
    RuleSyntaxError,
    exists_parts,
    format_value_list,
    has_unique,
    parse_list,
    parse_rule,
    to_sql,
)
from rowgate.functions.sql import quote_str


def sql(rule, col="c", dtype="string", col_type=None):
    return to_sql(parse_rule(rule), f"`{col}`", dtype, col_type if col_type is not None else dtype)


# Golden pairs: the documented rule examples and their expected expressions.
@pytest.mark.parametrize("col,dtype,rule,expected", [
    ("age", "int", "value must be greater than 18", "(`age` IS NULL) OR (`age` > 18)"),
    ("email", "string", "Should be a valid email address",
     f"(`email` IS NULL) OR (`email` RLIKE {quote_str(EMAIL_REGEX)})"),
    ("name", "string", "Not Null", "`name` IS NOT NULL"),
    ("status", "string", "Should be one of ['ACTIVE', 'INACTIVE']",
     "(`status` IS NULL) OR (`status` IN ('ACTIVE', 'INACTIVE'))"),
    ("zip_code", "int", "Must be a number", "true"),
    ("id", "int", "Should be a number and not null", "`id` IS NOT NULL"),
])
def test_golden_pairs(col, dtype, rule, expected):
    assert sql(rule, col, dtype) == expected


def test_email_literal_keeps_escaped_dot():
    # The SQL literal carries "\\." so Spark's parser yields the regex "\." (strict dot).
    assert "\\\\." in sql("Should be a valid email address")


@pytest.mark.parametrize("rule,op,value", [
    ("greater than 5", ">", "5"), ("more than 5", ">", "5"), ("must be > 5", ">", "5"),
    ("at least 5", ">=", "5"), ("greater than or equal to 5", ">=", "5"), (">= 5", ">=", "5"),
    ("less than 5", "<", "5"), ("below -2.5", "<", "-2.5"), ("at most 5", "<=", "5"),
    ("no more than 5", "<=", "5"), ("must not exceed 5", "<=", "5"), ("should not be less than 2", ">=", "2"), ("equal to 3", "=", "3"),
    ("not equal to 3", "<>", "3"), ("!= 3", "<>", "3"), ("should be positive", ">", "0"),
    ("non-negative", ">=", "0"), ("negative", "<", "0"),
])
def test_comparisons(rule, op, value):
    if op is None:
        with pytest.raises(RuleSyntaxError):
            parse_rule(rule)
        return
    spec = parse_rule(rule)
    assert spec.kind == "cmp" and spec.op == op and spec.values[0][1] == value


def test_between_is_not_split_on_and():
    spec = parse_rule("value must be between 1 and 10")
    assert spec.kind == "between"
    assert sql("between 1 and 10", "x", "int") == "(`x` IS NULL) OR (`x` BETWEEN 1 AND 10)"
    spec = parse_rule("must be between 1 and 10 and not null")
    assert spec.kind == "and" and [p.kind for p in spec.parts] == ["between", "not_null"]


def test_not_null_phrasings():
    for r in ["Not Null", "not null", "must not be null", "required", "cannot be null", "Should not be null",
              "is required", "non-null", "mandatory"]:
        assert parse_rule(r).kind == "not_null", r


def test_unique_phrasings():
    for r in ["Must be unique", "unique", "should be unique", "no duplicates", "values must be unique"]:
        assert parse_rule(r).kind == "unique", r
    assert sql("Must be unique") is None


def test_in_list_values_and_quotes():
    assert parse_list("['A', 'B']") == (("str", "A"), ("str", "B"))
    assert parse_list("['O''B', \"x,y\", 3]") == (("str", "O'B"), ("str", "x,y"), ("num", "3"))
    assert parse_list(r"['O\'B']") == (("str", "O'B"),)
    assert sql("must be one of ['O''B']") == "(`c` IS NULL) OR (`c` IN ('O\\'B'))"
    assert sql("one of [1, 2, 3]", "n", "int") == "(`n` IS NULL) OR (`n` IN (1, 2, 3))"
    assert format_value_list(["A", "O'B"]) == "['A', 'O''B']"
    assert parse_rule("Should be one of " + format_value_list(["A", "O'B"])).values == (("str", "A"), ("str", "O'B"))


def test_try_cast_only_when_types_differ():
    assert sql("greater than 18", "age", "int", "string") == "(`age` IS NULL) OR (TRY_CAST(`age` AS INT) > 18)"
    assert sql("greater than 18", "age", "int", "int") == "(`age` IS NULL) OR (`age` > 18)"
    # numeric comparison on a string-typed rule compares as double
    assert "TRY_CAST(`s` AS DOUBLE) > 5" in sql("greater than 5", "s", "string", "string")


def test_number_rule():
    assert sql("Must be a number", "x", "double") == "true"
    assert sql("Must be a number", "x", "string") == "(`x` IS NULL) OR (TRY_CAST(`x` AS DOUBLE) IS NOT NULL)"


def test_sql_passthrough_and_text_rules():
    assert sql("sql: a > b AND c IS NOT NULL") == "a > b AND c IS NOT NULL"
    assert sql("length at most 10") == "(`c` IS NULL) OR (length(`c`) <= 10)"
    assert sql("max length 10") == "(`c` IS NULL) OR (length(`c`) <= 10)"
    assert sql("length between 2 and 5") == "(`c` IS NULL) OR (length(`c`) BETWEEN 2 AND 5)"
    assert sql("must match pattern '^[A-Z]+$'") == "(`c` IS NULL) OR (`c` RLIKE '^[A-Z]+$')"
    assert sql("starts with 'AB'") == "(`c` IS NULL) OR (startswith(`c`, 'AB'))"
    assert sql("not empty") == "(`c` IS NULL) OR (TRIM(`c`) <> '')"


def test_compound_shares_lead():
    spec = parse_rule("Must be positive and less than 100")
    assert [p.kind for p in spec.parts] == ["cmp", "cmp"]
    assert sql("must be at least 1 and at most 9", "x", "int") == \
        "((`x` IS NULL) OR (`x` >= 1)) AND ((`x` IS NULL) OR (`x` <= 9))"


def test_unknown_text_raises():
    with pytest.raises(RuleSyntaxError):
        parse_rule("should look nice")
    with pytest.raises(RuleSyntaxError):
        parse_rule("")


def test_null_and_castable_and_format_rules():
    assert sql("must be null") == "`c` IS NULL"
    assert sql("allowed values: A, B, 'C D'") == "(`c` IS NULL) OR (`c` IN ('A', 'B', 'C D'))"
    assert sql("valid date", "d", "string") == "(`d` IS NULL) OR (TRY_CAST(`d` AS DATE) IS NOT NULL)"
    assert sql("valid date", "d", "date") == "true"
    assert sql("must be a valid integer", "n", "string") == "(`n` IS NULL) OR (TRY_CAST(`n` AS INT) IS NOT NULL)"
    assert sql("date format 'yyyy-MM-dd'", "d") == \
        "(`d` IS NULL) OR (try_to_timestamp(`d`, 'yyyy-MM-dd') IS NOT NULL)"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

WORDS = ["must", "should", "be", "not", "null", "unique", "one", "of", "['A', 'B']", "greater", "less", "than",
         "at", "least", "most", "between", "and", "5", "-2.5", "'x'", "valid", "email", "number", "length",
         "positive", "sql:", "x > 1", "(", ")", "[", "]", "'", "\"", "=", ">=", "allowed", "values:", "date",
         "format", "starts", "with", "contains", "match", "pattern", "empty", "required"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8))
def test_grammar_never_crashes(words):
    text = " ".join(words)
    try:
        spec = parse_rule(text)
    except RuleSyntaxError:
        return
    for dtype in ("string", "int", "double", "date"):
        try:
            out = to_sql(spec, "`c`", dtype, dtype)
        except RuleSyntaxError:
            continue
        assert out is None or isinstance(out, str)


def test_time_and_shape_rules():
    assert sql("must be in the past", "d", "date", "date") == \
        "(`d` IS NULL) OR (TRY_CAST(CAST(`d` AS STRING) AS TIMESTAMP) <= current_timestamp())"
    assert sql("not in the future", "d", "string") == \
        "(`d` IS NULL) OR (TRY_CAST(`d` AS TIMESTAMP) <= current_timestamp())"
    assert sql("date in the future", "d", "string").endswith("> current_timestamp())")
    assert sql("uppercase") == "(`c` IS NULL) OR (`c` = upper(`c`))"
    assert sql("should be lower case") == "(`c` IS NULL) OR (`c` = lower(`c`))"
    assert sql("digits only") == "(`c` IS NULL) OR (`c` RLIKE '^[0-9]+$')"
    assert sql("must be a valid url").startswith("(`c` IS NULL) OR (`c` RLIKE '^https?://")


def test_more_phrasings():
    assert sql("cannot be blank") == "(`c` IS NULL) OR (TRIM(`c`) <> '')"
    assert sql("Must be one of: A, B, C") == "(`c` IS NULL) OR (`c` IN ('A', 'B', 'C'))"
    assert sql("Must be 'Y' or 'N'") == "(`c` IS NULL) OR (`c` IN ('Y', 'N'))"
    assert sql("Must be a positive number", "x", "int") == "(`x` IS NULL) OR (`x` > 0)"
    assert sql("Age must be at least 18", "age", "int") == "(`age` IS NULL) OR (`age` >= 18)"
    assert sql("Email should be valid").startswith("(`c` IS NULL) OR (`c` RLIKE")
    assert sql("Status is required") == "`c` IS NOT NULL"
    with pytest.raises(RuleSyntaxError):
        parse_rule("Age must look nice")


ATOMS = ["not null", "must be a valid email address", "one of ['A', 'B']", "one of: A, B", "between 1 and 10", "at least 1,000",
         "must match pattern '^[A-Z]+ and$'", "starts with 'x or y'", "contains 'a'", "must not be negative", "must be true",
         "must be an integer", "must be 5 characters", "length between 2 and 5", "valid date", "date format 'yyyy-MM-dd'",
         "must not be one of ['it''s']", "not empty", "positive", "zero or positive", "greater than or equal to 3", "uppercase"]


@pytest.mark.parametrize("a", ATOMS)
def test_each_part_of_a_compound_keeps_its_own_meaning(a):
    """``A and B`` and ``A or B`` are what A and B are apart: nothing is lost or swallowed."""
    for b in ATOMS:
        left, right = sql(a), sql(b)
        both = [t for t in (left, right) if t != "true"]
        want = "true" if not both else both[0] if len(both) == 1 else f"({left}) AND ({right})"
        assert sql(f"{a} and {b}") == want, (a, b)


def test_unique_inside_compounds():
    assert sql("Must be unique and not null") == f"({UNIQUE_REF}) AND (`c` IS NOT NULL)"
    assert has_unique(parse_rule("must be a valid email and unique")) and not has_unique(parse_rule("not null"))


@pytest.mark.parametrize("rule", ["must look nice and not null", "not null and", "one of ['A'", "not unique", "in ('A') in ('B')",
                                  "starts with 'a' 'b'", "email maybe", "between 1 and", "must match pattern 'a' or else"])
def test_left_over_text_fails_loudly(rule):
    with pytest.raises(RuleSyntaxError):
        parse_rule(rule)


def test_alternatives_and_negations():
    assert sql("greater than 5 or null", "x", "int") == "((`x` IS NULL) OR (`x` > 5)) OR (`x` IS NULL)"
    assert sql("must not be null or empty") == "(`c` IS NOT NULL) AND ((`c` IS NULL) OR (TRIM(`c`) <> ''))"
    assert sql("should not be a valid email address").startswith("(`c` IS NULL) OR (NOT (")
    assert sql("can't be null") == "`c` IS NOT NULL"


def test_list_values_are_verbatim():
    assert parse_list("[New York, Paris]") == (("str", "New York"), ("str", "Paris"))
    assert parse_rule("one of ['A  B', 'x']").values[0] == ("str", "A  B")
    odd = ["a\\b", "ends\\", "O'B", "''", "\\'", "x, y", "two  spaces", "[z]", 'say "x"', ""]
    assert [v for _, v in parse_list(format_value_list(odd))] == odd
    assert sql("one of [01, 02]") == "(`c` IS NULL) OR (`c` IN ('01', '02'))"


# --- other columns, conditions, other tables ------------------------------------

COLS = {"status": "string", "price": "double", "min_price": "double", "max_price": "double", "quantity": "int", "total": "double",
        "start_date": "date", "end_date": "date", "shipped": "timestamp", "value": "double", "age": "string", "odd name": "int"}


def rel(text, col="price", dtype="double"):
    return to_sql(parse_rule(text, COLS), f"`{col}`", dtype, COLS[col], "NOW", COLS)


@pytest.mark.parametrize("text,col,want", [
    ("must be before end_date", "start_date", "`start_date` < `end_date`"),
    ("not before the start date", "end_date", "`end_date` >= `start_date`"),
    ("no later than end_date", "start_date", "`start_date` <= `end_date`"),
    ("greater than min_price", "price", "`price` > `min_price`"),
    ("must be at least the value of the min_price column", "price", "`price` >= `min_price`"),
    ("between min_price and max_price", "price", "`price` BETWEEN `min_price` AND `max_price`"),
    ("between 1 and max_price", "price", "`price` BETWEEN 1 AND `max_price`"),
    ("equal to quantity * price", "total", "`total` = try_multiply(`quantity`, `price`)"),
    ("at most twice the min price", "price", "`price` <= try_multiply(2, `min_price`)"),
    ("less than (price + min_price) / 2", "total", "`total` < try_divide(try_add(`price`, `min_price`), 2)"),
    ("at most 10% of total", "price", "`price` <= try_divide(try_multiply(10, `total`), 100)"),
    ("the same as `odd name`", "quantity", "`quantity` = `odd name`"),
    ("at least 3 days after start_date", "end_date", "`end_date` >= try_add(`start_date`, INTERVAL '3' DAY)"),
    ("more than 2 weeks before end_date", "start_date", "`start_date` < try_subtract(`end_date`, INTERVAL '2' WEEK)"),
    ("within a month after start_date", "end_date", "`end_date` BETWEEN `start_date` AND try_add(`start_date`, INTERVAL '1' MONTH)"),
    ("within 2 days of start_date", "end_date",
     "`end_date` BETWEEN try_subtract(`start_date`, INTERVAL '2' DAY) AND try_add(`start_date`, INTERVAL '2' DAY)"),
    ("after start_date", "shipped", "`shipped` > TRY_CAST(`start_date` AS TIMESTAMP)"),
    ("greater than quantity", "age", "TRY_CAST(`age` AS INT) > `quantity`"),
])
def test_other_columns(text, col, want):
    dtype = "int" if col == "age" else COLS[col]
    assert rel(text, col, dtype) == f"(`{col}` IS NULL) OR ({want})"


def test_subjects():
    own, other = "(`price` IS NULL) OR (`price` > 0)", "(`status` IS NULL) OR (`status` IN ('A', 'B'))"
    assert rel("price must be positive") == rel("value must be positive") == rel("it must be positive") == own
    assert rel("status must be 'A' or 'B'") == other
    assert rel("status must be one of ['A', 'B'] and price must be positive") == f"({other}) AND ({own})"
    for text in ("status must look nice", "status must be 'A' and must glow", "`status` must be shiny"):
        with pytest.raises(RuleSyntaxError):
            rel(text)  # a column is never dropped as filler


def when(column, rule):
    return f"CASE WHEN `{column}` IS NOT NULL THEN ({rule}) END"


def test_conditions():
    is_a = when("status", "(`status` IS NULL) OR (`status` IN ('A'))")
    positive = "(`price` IS NULL) OR (`price` > 0)"
    for text in ("if status is 'A' then must be positive", "if status is A, must be positive", "must be positive if status = 'A'",
                 "when status equals 'A' then price must be positive", "must be positive whenever status is 'A'"):
        assert rel(text) == f"CASE WHEN {is_a} THEN ({positive}) ELSE true END", text
    assert rel("must be positive unless status is 'A'") == f"CASE WHEN {is_a} THEN true ELSE ({positive}) END"
    assert rel("if status is 'A' then must be positive otherwise must be null") == \
        f"CASE WHEN {is_a} THEN ({positive}) WHEN NOT ({is_a}) THEN (`price` IS NULL) ELSE true END"
    assert rel("required if status is missing or quantity is greater than 5") == \
        f"CASE WHEN (`status` IS NULL) OR ({when('quantity', '(`quantity` IS NULL) OR (`quantity` > 5)')}) THEN (`price` IS NOT NULL) ELSE true END"
    assert rel("if the value is not null then min_price must not be null").startswith("CASE WHEN `price` IS NOT NULL THEN (`min_price`")
    for text in ("must be positive only if status is 'A'", "if status is 'A'", "unique if status is 'A'", "if it glows then not null",
                 "if nonsense is 'A' then not null", "if status is 'A' then must look nice"):
        with pytest.raises(RuleSyntaxError):
            rel(text)


def test_existence_texts():
    for text in ("must exist in shop.customers.id", "references shop.customers(id)", "must be present in the id column of shop.customers",
                 "should be a valid foreign key to shop.customers(id)"):
        assert exists_parts(parse_rule(text, COLS), "price") == [("price", "shop.customers", "id")], text
    both = parse_rule("if status is 'A' then quantity must exist in `odd t`.`k y`", COLS)
    assert exists_parts(both, "price") == [("quantity", "`odd t`", "k y")]


def test_unquoted_texts_fail_loudly_and_classes_are_understood():
    for text in ("contains foo", "must not contain bad words", "starts with abc", "ends with .com"):
        with pytest.raises(RuleSyntaxError, match="quote"):
            parse_rule(text)
    assert sql("must not contain special characters") == "(`c` IS NULL) OR (NOT ((`c` IS NULL) OR (`c` RLIKE '[^A-Za-z0-9\\\\s]')))"
    assert sql("contains at least one digit") == "(`c` IS NULL) OR (`c` RLIKE '[0-9]')"
    assert sql("contains only letters, digits and underscores") == "(`c` IS NULL) OR (`c` RLIKE '^[A-Za-z0-9_]*$')"
    assert sql("starts with a letter") == "(`c` IS NULL) OR (`c` RLIKE '^(?:[A-Za-z])')"


def test_lists_of_bare_words():
    for text in ("should be A, B or C", "must be either A, B, or C", "either A, B or C"):
        assert sql(text) == "(`c` IS NULL) OR (`c` IN ('A', 'B', 'C'))", text
    assert sql("either A or B") == "(`c` IS NULL) OR (`c` IN ('A', 'B'))"
    assert sql("must be 'x'") == "(`c` IS NULL) OR (`c` IN ('x'))"
    assert sql("either positive or null", "x", "int") == "((`x` IS NULL) OR (`x` > 0)) OR (`x` IS NULL)"
    for text in ("must look nice, or good", "should be positive, shiny or null", "A, B or C"):
        with pytest.raises(RuleSyntaxError):
            parse_rule(text)
