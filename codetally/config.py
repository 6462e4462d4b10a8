"""Column roles, passed in by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnConfig:
    """Which columns of a wide evaluation table hold what."""

    model_label_cols: list[str]
    model_score_cols: list[str]
    clerical_label_cols: list[str]
    id_col: str = "id"
    filter_unambiguous: bool = False

    @property
    def label_cols(self) -> list[str]:
        return [*self.model_label_cols, *self.clerical_label_cols]

    @property
    def required_cols(self) -> list[str]:
        extra = ["Unambiguous"] if self.filter_unambiguous else []
        return [self.id_col, *self.model_label_cols, *self.model_score_cols, *self.clerical_label_cols, *extra]


@dataclass(frozen=True)
class ConfusionConfig:
    """Which two code columns to cross, how many codes of each to keep, what to leave out."""

    human_code_col: str
    model_code_col: str
    top_n: int = 10
    exclude_patterns: list[str] = field(default_factory=list)
