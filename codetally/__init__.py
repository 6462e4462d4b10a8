"""How well do automatically assigned classification codes agree with human coders? As Spark jobs."""

from codetally.config import ColumnConfig, ConfusionConfig
from codetally.operators.alignment import LabelAlignment
from codetally.operators.hierarchy import Hierarchy
from codetally.operators.metrics import accuracy_metrics, ambiguity_metrics, codability_metrics, evaluation_metrics
from codetally.operators.prepare import clean_wide_table, prepare_clerical_codes, prepare_model_codes
from codetally.operators.quality import add_quality_flags

__all__ = [
    "ColumnConfig",
    "ConfusionConfig",
    "Hierarchy",
    "LabelAlignment",
    "accuracy_metrics",
    "add_quality_flags",
    "ambiguity_metrics",
    "clean_wide_table",
    "codability_metrics",
    "evaluation_metrics",
    "prepare_clerical_codes",
    "prepare_model_codes",
]
