"""Thresholds of the analysis, in one place.  Fixed values: results depend on them."""

IQR_FACTOR, MAD_SCALE, MAD_CUT = 1.5, 1.4826, 3.0
TEMPORAL_SHARE, CATEGORICAL_RATIO, CATEGORICAL_LENGTH = 0.9, 0.2, 24
SPARSE, SKEWED, NEAR_CONSTANT = 0.5, 1.0, 0.01
PEARSON_STRONG, CORRELATION_REPORTED, CRAMER_REPORTED = 0.8, 0.7, 0.3
GAP_FACTOR = 1.5
MIN_GROUP, MIN_STABLE, EFFECT_CAP = 5, 30, 3.0
STD_SHIFT, TVD_NOTED = 0.10, 0.15
IDENTIFIER_NAMES = ("id", "index", "row_id", "record_id")
TARGET_TOKENS = ("target", "label", "outcome", "result", "score", "temperature")
TOP_K, POOL_FACTOR, MIN_TOPIC = 5, 2, 3
BOOST, PENALTY = 1.15, 0.75
NEAR_DISTANCE, FAR_DISTANCE = 1.05, 1.82
CONTEXT_BUDGET = 12_000
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
