from loomwright.queries.registry import ORACLE, QUERIES  # noqa: F401
from loomwright.queries import sources_checks, scalar, missing_encode, joins, history, windows_sets, encoding_folds, metrics_decide, blend, profile, text, models  # noqa: F401
