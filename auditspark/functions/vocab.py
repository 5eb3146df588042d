"""The closed vocabularies and thresholds that results are defined by."""

# Fixed values.
DEFAULT_SEED = 20260822
DEFAULT_LOOP_CAP = 3
MISSING_LEVEL = "<MISSING>"
BASELINE_MISSING_LEVEL = "__missing__"
MAX_LEVELS = 20
MAX_BALANCE_CLASSES = 20
BIN_ABOVE_DISTINCT = 12
N_BINS = 10
ID_DISTINCT_SHARE = 0.98
SAMPLE_VALUES = 5
ERROR_MESSAGE_LIMIT = 500
NOTE_LIMIT = 120
HOLDOUT_FRACTION = 0.2
N_FOLDS = 5
MAX_FOLDS = 10
MIN_AGENT_ROWS = 10
PERMUTATION_REPEATS = 10
TOP_IMPORTANCES = 15
IMPORTANCE_MASS = 0.8
MIN_SEPARATION = 1e-9
REFIT_TOLERANCE = 1e-6
WILSON_Z = 1.96
MAX_CONSECUTIVE_FAILURES = 3
BASELINE_RECIPE = "rf-v1"

# Closed string vocabularies.
TASK_TYPES = ("binary", "multiclass", "regression")
GREATER_IS_BETTER = {
    "roc_auc": True,
    "accuracy": True,
    "f1": True,
    "r2": True,
    "log_loss": False,
    "rmse": False,
    "mae": False,
}
CATEGORIES = (
    "leakage",
    "contamination",
    "overfit",
    "metric_mismatch",
    "implausible_importance",
    "spec_violation",
    "other",
)
COLUMN_SCOPED = ("leakage", "contamination", "implausible_importance")
LEAK_CATEGORIES = ("leakage", "contamination")
ACTING_NODES = ("feature_eng", "modeler")
DISPOSITIONS = ("still_open", "resolved", "withdrawn", "not_reviewed")
CLOSING = ("resolved", "withdrawn")
VERDICTS = ("pending", "pass", "block", "exhausted")
SEVERITIES = ("low", "medium", "high")
PLACEHOLDER_MODELS = ("stub",)
RESCORE_STATUSES = (
    "not_attempted",
    "no_withheld_holdout",
    "no_spec",
    "no_split",
    "no_feature_code",
    "empty_matrix",
    "no_model",
    "unknown_model_spec",
    "single_class_holdout",
    "snippet_failed",
    "sandbox_error",
    "refit_mismatch",
    "ok",
)
BASELINE_STATUSES = (
    "not_attempted",
    "no_withheld_holdout",
    "rescore_unavailable",
    "empty_source_matrix",
    "single_class_train",
    "zero_point_failed",
    "unit_point_failed",
    "snippet_failed",
    "sandbox_error",
    "ok",
)

# The run conditions two result rows must share to be compared.
CONDITION_FIELDS = (
    "dataset_id",
    "arm",
    "reviewer_enabled",
    "default_model",
    "reviewer_model",
    "reviewer_prompt",
    "reviewer_sees_code",
    "naming",
    "loop_cap",
    "objection_routing",
    "objection_closure",
    "forced_drop_release",
    "random_seed",
    "commit",
)
DEFAULT_METRICS = ("leakage_remediated", "leakage_caught", "reviewer_caught", "errored")
CONTINUOUS_COLUMNS = ("cost_usd", "review_loops", "n_final_features")
FLIP_METRICS = ("leakage_remediated", "leakage_caught")

# Dataset admission rule.
SELECTION = {
    "max_rows": 100_000,
    "max_features": 200,
    "max_cells": 5_000_000,
    "min_usable_features": 5,
    "target_low": 10,
    "target_high": 15,
}

# The tokens pandas reads as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
