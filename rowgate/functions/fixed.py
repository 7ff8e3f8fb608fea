"""Fixed values that must equal the reference tool's for identical results.

Everything here is data, stated once, in natural order.
"""

# --- fixed values (rule contract) -------------------------------------------

# Email pattern used both for the email rule and for the profiler's email share.
EMAIL_REGEX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,6}$"

# Per-row error message for a failed business rule.
ERROR_MESSAGE = "FAILED RULE: For column '{column}', rule was: '{rule}'"

# Rule texts proposed by the profiler.
RULE_NOT_NULL = "Not Null"
RULE_UNIQUE = "Must be unique"
RULE_ONE_OF = "Should be one of {values}"
RULE_EMAIL = "Should be a valid email address"

# Profiler thresholds: in-list for 2..10 distinct values, email for > 80 % matches.
IN_LIST_MIN_DISTINCT = 2
IN_LIST_MAX_DISTINCT = 10
EMAIL_SHARE_THRESHOLD = 0.8

# Check-column naming: non [a-zA-Z0-9_] -> "_", lower case, rule text cut to 30.
NAME_SANITIZE_PATTERN = r"[^a-zA-Z0-9_]"
RULE_NAME_PREFIX_LENGTH = 30
TYPE_CHECK_SUFFIX = "_type_ok"
RULE_CHECK_SUFFIX = "_ok"

# Sample-row generator: 4 semi-valid rows and one all-null row.
SAMPLE_ROWS = 4
SAMPLE_INVALID_EMAIL = "invalid-email"
SAMPLE_EMAIL = "user{i}@example.com"
SAMPLE_STATUS_EVEN = "ACTIVE"
SAMPLE_STATUS_ODD = "INACTIVE"
SAMPLE_NAME = "FirstName{i}"
SAMPLE_OTHER = "value_{i}"
SAMPLE_INT_STEP = 10
SAMPLE_DOUBLE_STEP = 1.1
SAMPLE_FIRST_DATE = "2024-01-01"
SAMPLE_TIME_OF_DAY = "12:00:00"
