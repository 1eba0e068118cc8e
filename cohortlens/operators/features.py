"""Domain feature block and task projections."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import expr as E
from cohortlens.functions.domain import (
    AT_RISK_BELOW,
    CATEGORICAL_COLUMNS,
    HIGH_FROM,
    MEDIUM_FROM,
    PARENTAL_EDUCATION,
    PASS_MARK,
    PERFORMANCE_LEVELS,
    SCORE_COLUMNS,
)

ENGINEERED_COLUMNS = (
    "total_score", "average_score", "score_std", "min_score", "max_score", "score_range",
    "pass_math", "pass_reading", "pass_writing", "n_passed", "all_passed",
    "performance_level", "at_risk", "parental_education_rank",
)


def parental_rank(c: str = "parental_level_of_education"):
    """Ordinal 0-5 in declared order; unknown → null."""
    pos = F.array_position(F.array(*[F.lit(v) for v in PARENTAL_EDUCATION]), F.col(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def engineer(df: DataFrame, pass_mark: float = PASS_MARK, at_risk_below: float = AT_RISK_BELOW,
             medium_from: float = MEDIUM_FROM, high_from: float = HIGH_FROM) -> DataFrame:
    """Append the 14 engineered columns in one projection (codegen'd, no shuffle).

    Null scores are skipped by the row statistics; flags treat null as fail.
    The average is rounded (half-even, 2 dp) before the tier and at-risk cut-offs.
    """
    s = list(SCORE_COLUMNS)
    avg = E.round_half_even(E.row_mean(s), 2)
    out = df.withColumns({
        "total_score": E.row_sum(s),
        "average_score": avg,
        "score_std": E.round_half_even(E.row_std_samp(s), 2),
        "min_score": F.least(*[F.col(c) for c in s]),
        "max_score": F.greatest(*[F.col(c) for c in s]),
    })
    out = out.withColumns({
        "score_range": F.col("max_score") - F.col("min_score"),
        "pass_math": E.flag(F.col("math_score") >= F.lit(float(pass_mark))),
        "pass_reading": E.flag(F.col("reading_score") >= F.lit(float(pass_mark))),
        "pass_writing": E.flag(F.col("writing_score") >= F.lit(float(pass_mark))),
    })
    a = F.col("average_score")
    out = out.withColumns({
        "n_passed": F.col("pass_math") + F.col("pass_reading") + F.col("pass_writing"),
        "performance_level": F.when(a < F.lit(float(medium_from)), "low")
                              .when(a < F.lit(float(high_from)), "medium")
                              .when(a.isNotNull(), "high"),
        "at_risk": E.flag(a < F.lit(float(at_risk_below))),
    })
    out = out.withColumn("all_passed", (F.col("n_passed") == 3).cast("int"))
    if "parental_level_of_education" in df.columns:
        out = out.withColumn("parental_education_rank", parental_rank())
    return out


class Task:
    """What is learned from which columns: ``levels`` are the labels in code order (none: a number is predicted),
    ``metrics`` are reported in this order and the first one ranks models."""

    def __init__(self, target: str, inputs: Sequence[str], metrics: Sequence[str], levels: Sequence = ()):
        self.name = self.target = target
        self.inputs = tuple(inputs)
        self.metrics = tuple(metrics)
        self.levels = tuple(levels)
        self.kind = {0: "regression", 2: "binary"}.get(len(self.levels), "multiclass")

    def code(self):
        """The label as a number: itself, or the place among the levels (-1 for an unknown one)."""
        y = F.col(self.target)
        if self.kind != "multiclass":
            return y
        at = F.array_position(F.array(*[F.lit(v) for v in self.levels]), y)
        return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(-1))

    def level(self, code: str):
        """The label of a code."""
        if self.kind == "multiclass":
            return F.element_at(F.array(*[F.lit(v) for v in self.levels]), F.col(code).cast("int") + 1)
        return F.col(code).cast("int" if self.levels else "double")


_AT_RISK = Task("at_risk", CATEGORICAL_COLUMNS, levels=(0, 1), metrics=(
    "roc_auc", "average_precision", "f1", "recall", "precision", "balanced_accuracy"))
_MATH = Task("math_score", (*CATEGORICAL_COLUMNS, "reading_score", "writing_score"), metrics=(
    "r2", "neg_root_mean_squared_error", "neg_mean_absolute_error"))
_TIER = Task("performance_level", (*CATEGORICAL_COLUMNS, *SCORE_COLUMNS), levels=PERFORMANCE_LEVELS, metrics=(
    "f1_macro", "accuracy", "balanced_accuracy"))
TASKS = {t.name: t for t in (_AT_RISK, _MATH, _TIER)}


def build_xy(task: Task, engineered: DataFrame, label_col: str = "label",
             keep: Sequence[str] = ()) -> DataFrame:
    """Features + target; multiclass target → class code (unknown → -1)."""
    return engineered.select(*keep, *task.inputs, task.code().cast("double").alias(label_col))


def decode(task: Task, code_col: str):
    """Class code → label (classification), identity otherwise."""
    return task.level(code_col)


def keep_columns(df: DataFrame, keep: Sequence[str], **limits: float) -> DataFrame:
    """Engineer when all scores are present (else only the rank), then ``select(keep)``."""
    if all(c in df.columns for c in SCORE_COLUMNS):
        df = engineer(df, **limits)
    elif "parental_level_of_education" in df.columns:
        df = df.withColumn("parental_education_rank", parental_rank())
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise KeyError(f"cannot produce columns {missing}")
    return df.select(*keep) if keep else df
