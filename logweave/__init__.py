"""logweave: Spark-native log analytics -- parsing, profiling, preprocess and
feature step chains, training-input selection, anomaly scoring and result
analysis, each a lazy ``DataFrame -> DataFrame`` operator."""

from .plans.chain import run_features, run_preprocess  # noqa: F401
from .rowid import ROW_ID, with_row_id  # noqa: F401
from .session import get_spark  # noqa: F401
