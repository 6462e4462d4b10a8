"""The words, patterns and numbers that decide what a code means.

They are part of the data format, not tunables: changing one changes results.
"""

# Special codes a coder can enter instead of a classification code.
NOT_CODABLE = "-9"
FOUR_OR_MORE = "4+"

# Width every numeric code is zero-padded to.
CODE_LENGTH = 5

# One code inside free text: digits, then x's standing for unknown digits.
CODE_PATTERN = "([0-9]+x*X*)"

# Text that means "no label" once a label column is read as text.
MISSING_TOKENS = ["", " ", "nan", "None", "Null", "<NA>"]

# Text that is never a code. A null is treated the same way.
INVALID_TOKENS = ["-9", "4+", "", ".", " ", "NAN", "NaN", "nan", "None", "Null", "<NA>"]

# Cells a text-typed CSV read turns into null.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# How a set of human codes may be compared with a set of model codes.
MATCH_METHODS = ["OO", "OM", "MO", "MM"]

# Confidence grid 0, 0.05, ... 1 and the thresholds of the summary table.
THRESHOLD_GRID = [i * 0.05 for i in range(21)]
SUMMARY_THRESHOLDS = [0.5, 0.6, 0.7, 0.8]

# Group-membership table, in print order.
MEMBERSHIP_GROUPS = [
    "Uncodeable",
    "4+ Codes",
    "Codeable to 2 digits only",
    "Codeable to 3 digits only",
    "Codeable unambiguously to 5 digits",
    "Codeable ambiguously to 5 digits",
    "Other",
    "Total",
]

# Boolean columns produced by the quality flags.
QUALITY_FLAGS = ["Match_5_digits", "Match_3_digits", "Match_2_digits", "Unambiguous"]

# 97.5 % point of the normal distribution, as used for the Wald interval.
WALD_Z = 1.96

# Distance-to-confidence weights.
DISTANCE_EPSILON = 0.00001
DISTANCE_WEIGHT = 0.4
RANK_WEIGHT = 0.1
