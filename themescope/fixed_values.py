"""Fixed values.

Everything in this file is data whose exact text decides the results: column names, label
variants, patterns, markers, closed domains and default parameters.  Nothing here is logic.
"""

# Raw export column -> column name used everywhere else.
COLUMN_MAP = {
    "Date received": "date",
    "Product": "product",
    "Sub-product": "sub_product",
    "Consumer complaint narrative": "narrative",
    "Company": "company",
    "State": "state",
    "Submitted via": "channel",
    "Complaint ID": "complaint_id",
}

# Held-out label columns; never part of the table that a model sees.
TRUTH_COLUMNS = ["Issue", "Sub-issue"]

# Historical product label -> the label it counts as.  Labels not listed stay as they are.
CANONICAL_PRODUCT = {
    "Credit reporting": "Credit reporting",
    "Credit reporting or other personal consumer reports": "Credit reporting",
    "Credit reporting, credit repair services, or other personal consumer reports": "Credit reporting",
    "Checking or savings account": "Checking or savings account",
    "Bank account or service": "Checking or savings account",
    "Credit card": "Credit card",
    "Credit card or prepaid card": "Credit card",
    "Prepaid card": "Prepaid card",
    "Payday loan": "Payday/title/personal loan",
    "Payday loan, title loan, or personal loan": "Payday/title/personal loan",
    "Payday loan, title loan, personal loan, or advance loan": "Payday/title/personal loan",
    "Vehicle loan or lease": "Vehicle or consumer loan",
    "Consumer Loan": "Vehicle or consumer loan",
    "Money transfer, virtual currency, or money service": "Money transfer or virtual currency",
    "Money transfers": "Money transfer or virtual currency",
    "Virtual currency": "Money transfer or virtual currency",
}

# Products left out of the working set.
DROP_PRODUCTS = ["Other financial service", "Other", "Non-financial product/service"]

# Label prefix of the stratum that is thinned out, and the share of it that stays.
STRATUM_PREFIX = "Credit reporting"
STRATUM_FRACTION = 0.03

# Text cleaning, applied in this order (Java syntax; (?U) gives \s and \d their Unicode
# meaning, and the look-arounds are a word boundary over letters, digits and underscore).
# Each pattern starts with its literal, so the matcher skips to candidates and tests the
# boundary only there.
CLEAN_RULES = [
    (r"(?U)\{\$[\d,]+\.?\d*\}", " [AMOUNT] "),
    (r"(?U)XX/XX/(?<![\p{L}\p{N}_]XX/XX/)(?:XXXX|\d{4})(?![\p{L}\p{N}_])", " [DATE] "),
    (r"XX/XX(?<![\p{L}\p{N}_]XX/XX)(?![\p{L}\p{N}_])", " [DATE] "),
    (r"XX(?<![\p{L}\p{N}_]XX)X*+(?![\p{L}\p{N}_])", " [REDACTED] "),
    (r"(?U)\[REDACTED\][\s\x1c-\x1f]*(?:\[REDACTED\][\s\x1c-\x1f]*)+", " [REDACTED] "),
    (r"(?U)[\s\x1c-\x1f]+", " "),
]
# A text holding none of these is changed by the whitespace rule only.
CLEAN_TRIGGERS = ["XX", "{$", "[REDACTED]"]

WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
OUTER_WHITESPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = r"(?U)[^\s\x1c-\x1f]+"
ISO_DAY_PREFIX = r"^\d{4}-\d{2}-\d{2}"
DAY_FORMAT = "yyyy-MM-dd"

# Texts that the pandas CSV reader takes for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Closed sentiment domain and the value everything else becomes.
SENTIMENTS = ["Negative", "Neutral", "Positive"]
DEFAULT_SENTIMENT = "Neutral"

# Columns the report step cannot do without.
REPORT_COLUMNS = ["general_topic_l1", "topic_discussed", "product", "date", "customer_sentiment"]

# Default parameters.
MIN_DATE = "2023-01-01"
MIN_WORDS = 30
MAX_WORDS = 3000
KEEP_WORDS = 400
SAMPLE_TARGET = 3000
HOLDOUT_ROWS = 200
MAX_TOPICS_PER_ROW = 5
MAX_QUOTE_CHARS = 160
MAX_ERROR_CHARS = 160
ERROR_SAMPLES = 3
ATTEMPTS_PER_MODEL = 2
CHECKPOINT_ROWS = 100
BATCH_ITEMS = 100
BATCH_TOKENS = 6000
CHARS_PER_TOKEN = 4
N_CLUSTERS = 12
KMEANS_STARTS = 10
SEED = 42
TOP_THEMES = 5
SAMPLE_TOPICS = 15
MIN_CATEGORY_SUPPORT = 10
JUNK_MIN_CATEGORIES = 5
JUNK_MAX_PURITY = 0.3
RELIABLE_ROWS = 200
MATCH_SHARE = 0.5
FALLBACK_LABEL = "Theme "
TOPIC_SEPARATOR = "; "
