"""Registered queries: ingest, cleaning, validation, features, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.domain import (
    CATEGORICAL_COLUMNS,
    GENDERS,
    ETHNICITIES,
    LUNCH,
    PARENTAL_EDUCATION,
    PERFORMANCE_LEVELS,
    SCORE_COLUMNS,
    TEST_PREP,
)
from cohortlens.operators import clean as C
from cohortlens.operators import features as X
from cohortlens.operators import profiling as A
from cohortlens.operators.validate import violations
from cohortlens.plans.registry import register
from cohortlens.plans.sql_helpers import quantile_ctes, r2, r3, union_all
from cohortlens.plans.sql_inputs import CLEANED, ENGINEERED, STUDENTS, STUDENTS_DIRTY, with_ctes
from cohortlens.sources import derived as D

STUDENT_COLS = ["student_id", *CATEGORICAL_COLUMNS, *SCORE_COLUMNS]
_DOMAINS = {
    "gender": GENDERS, "race_ethnicity": ETHNICITIES,
    "parental_level_of_education": PARENTAL_EDUCATION, "lunch": LUNCH,
    "test_preparation_course": TEST_PREP,
}


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def engineered_students(spark, sf_dir):
    return X.engineer(D.students(spark, sf_dir))


ENG = with_ctes(STUDENTS, ENGINEERED)

# --------------------------------------------------------------------------- cleaning


@register("clean_distinct", with_ctes(STUDENTS, STUDENTS_DIRTY, CLEANED) + "SELECT * FROM cleaned",
          floats=list(SCORE_COLUMNS))
def clean_distinct(spark, sf_dir):
    """trim/lower strings, restore 'group X', drop exact duplicates."""
    return C.clean(C.normalise_columns(D.students_dirty(spark, sf_dir)))


@register("duplicate_report", with_ctes(STUDENTS, STUDENTS_DIRTY, CLEANED) + """
SELECT (SELECT count(*) FROM dirty) AS n_before, (SELECT count(*) FROM cleaned) AS n_after,
       (SELECT count(*) FROM dirty) - (SELECT count(*) FROM cleaned) AS n_dropped""")
def duplicate_report(spark, sf_dir):
    """C3 report: rows before / after de-duplication."""
    return C.duplicate_report(D.students_dirty(spark, sf_dir))


def _violations_sql() -> str:
    parts = []
    for c in CATEGORICAL_COLUMNS:
        parts.append(f"SELECT '{c}' AS column_name, 'unknown_category' AS problem, "
                     f"CAST({c} AS VARCHAR) AS detail, count(*) AS n FROM cleaned "
                     f"WHERE {c} NOT IN {_in(_DOMAINS[c])} GROUP BY {c}")
    for c in [*CATEGORICAL_COLUMNS, *SCORE_COLUMNS]:
        parts.append(f"SELECT '{c}', 'missing_values', CAST(NULL AS VARCHAR), count(*) FROM cleaned "
                     f"WHERE {c} IS NULL HAVING count(*) > 0")
    for c in SCORE_COLUMNS:
        parts.append(f"SELECT '{c}', 'below_min', '0', count(*) FROM cleaned WHERE {c} < 0 HAVING count(*) > 0")
        parts.append(f"SELECT '{c}', 'above_max', '100', count(*) FROM cleaned WHERE {c} > 100 HAVING count(*) > 0")
    return with_ctes(STUDENTS, STUDENTS_DIRTY, CLEANED) + union_all(parts)


@register("validate_violations", _violations_sql())
def validate_violations(spark, sf_dir):
    """V1-V6: every rule violation of the cleaned table, one row per problem."""
    return violations(C.clean(D.students_dirty(spark, sf_dir)))


# --------------------------------------------------------------------------- features


@register("engineered", ENG + "SELECT * FROM eng",
          floats=[*SCORE_COLUMNS, "total_score", "average_score", "score_std", "min_score",
                  "max_score", "score_range"])
def engineered(spark, sf_dir):
    """The 14 engineered columns."""
    return engineered_students(spark, sf_dir)


@register("task_xy_multiclass", ENG + """
SELECT student_id, gender, race_ethnicity, parental_level_of_education, lunch,
  test_preparation_course, math_score, reading_score, writing_score,
  CAST(coalesce(list_position(['low', 'medium', 'high'], performance_level) - 1, -1) AS DOUBLE) AS label
FROM eng""", floats=[*SCORE_COLUMNS, "label"])
def task_xy_multiclass(spark, sf_dir):
    """Multiclass projection with class codes (unknown → -1)."""
    return X.build_xy(X.TASKS["performance_level"], engineered_students(spark, sf_dir), keep=["student_id"])


# --------------------------------------------------------------------------- profiling


@register("headline_stats", ENG + """
SELECT count(*) AS n_students, avg(at_risk) AS at_risk_rate, avg(average_score) AS average_score,
  avg(math_score) AS mean_math_score, avg(reading_score) AS mean_reading_score,
  avg(writing_score) AS mean_writing_score,
  count(*) FILTER (WHERE performance_level = 'low') / count(*) AS share_low,
  count(*) FILTER (WHERE performance_level = 'medium') / count(*) AS share_medium,
  count(*) FILTER (WHERE performance_level = 'high') / count(*) AS share_high
FROM eng""", floats=["at_risk_rate", "average_score", "mean_math_score", "mean_reading_score",
                      "mean_writing_score", "share_low", "share_medium", "share_high"])
def headline_stats(spark, sf_dir):
    """A1: headline statistics in one aggregate."""
    return A.headline_stats(engineered_students(spark, sf_dir))


def _group_stats_sql() -> str:
    parts = [f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, count(*) AS n, "
             f"avg(at_risk) AS at_risk_rate, avg(average_score) AS avg_score FROM eng GROUP BY {a}"
             for a in A.GROUP_ATTRIBUTES]
    return ENG + union_all(parts)


@register("group_stats", _group_stats_sql(), floats=["at_risk_rate", "avg_score"])
def group_stats(spark, sf_dir):
    """A2: at-risk rate and mean score by every background attribute, in one pass."""
    return A.group_stats(engineered_students(spark, sf_dir))


def _describe_sql() -> str:
    src = union_all([f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM eng "
                     f"WHERE {c} IS NOT NULL" for c in SCORE_COLUMNS])
    q = quantile_ctes("qq", "longv", ["column_name"], "value", [0.25, 0.5, 0.75])
    return ENG.rstrip() + f""",
longv AS ({src}),
{q.strip()}
SELECT b.column_name, b.cnt AS count, {r2('b.mean')} AS mean, {r2('b.std')} AS std,
  {r2('b.mn')} AS min, {r2('q1.value')} AS p25, {r2('q2.value')} AS p50, {r2('q3.value')} AS p75,
  {r2('b.mx')} AS max
FROM (SELECT column_name, count(*) AS cnt, avg(value) AS mean, stddev_samp(value) AS std,
             min(value) AS mn, max(value) AS mx FROM longv GROUP BY column_name) b
JOIN qq q1 ON q1.column_name = b.column_name AND q1.prob = 0.25
JOIN qq q2 ON q2.column_name = b.column_name AND q2.prob = 0.5
JOIN qq q3 ON q3.column_name = b.column_name AND q3.prob = 0.75"""


@register("describe_scores", _describe_sql(),
          floats=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe_scores(spark, sf_dir):
    """A4: describe() of the three scores with exact linear quartiles."""
    return A.describe(engineered_students(spark, sf_dir))


def _corr_sql() -> str:
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0::DOUBLE AS corr FROM (SELECT 1) t"
             for c in SCORE_COLUMNS]
    cols = list(SCORE_COLUMNS)
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}', '{b}', {r3(f'corr({a}, {b})')} FROM eng")
            parts.append(f"SELECT '{b}', '{a}', {r3(f'corr({a}, {b})')} FROM eng")
    return ENG + union_all(parts)


@register("corr_matrix", _corr_sql(), floats=["corr"])
def corr_matrix(spark, sf_dir):
    """A5: Pearson correlation matrix of the scores (long form, 3 dp)."""
    return A.correlation(engineered_students(spark, sf_dir))


@register("category_counts", ENG + union_all([
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, count(*) AS n "
    f"FROM eng WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL_COLUMNS]))
def category_counts(spark, sf_dir):
    """Value counts of every categorical column."""
    return A.category_counts(engineered_students(spark, sf_dir))


@register("level_share", ENG + f"""
SELECT CAST(o.class_order AS INTEGER) AS class_order, o.level, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  {r3('coalesce(c.n, 0) / (SELECT count(*) FROM eng)')} AS share
FROM (VALUES {", ".join(f"({i}, '{lv}')" for i, lv in enumerate(PERFORMANCE_LEVELS))}) o(class_order, level)
LEFT JOIN (SELECT performance_level AS level, count(*) AS n FROM eng GROUP BY 1) c ON c.level = o.level""",
          floats=["share"])
def level_share(spark, sf_dir):
    """Performance-level counts and shares in class order."""
    return A.class_share(engineered_students(spark, sf_dir))


@register("table_shape", with_ctes(STUDENTS, STUDENTS_DIRTY) + f"""
SELECT count(*) AS n_rows, CAST({len(STUDENT_COLS)} AS BIGINT) AS n_columns,
  CAST(sum({" + ".join(f"({c} IS NULL)::BIGINT" for c in STUDENT_COLS)}) AS BIGINT) AS missing_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates
FROM dirty""")
def table_shape(spark, sf_dir):
    """Rows, columns, missing values and duplicate rows of the raw table."""
    return A.table_shape(D.students_dirty(spark, sf_dir))


def _tests_sql() -> str:
    mom = union_all([f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, count(*) AS n, "
                     f"avg(average_score) AS m, var_samp(average_score) AS v FROM eng "
                     f"WHERE average_score IS NOT NULL GROUP BY {a}" for a in CATEGORICAL_COLUMNS])
    return ENG.rstrip() + f""",
mom AS ({mom}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY grp) AS gi FROM mom),
per AS (
  SELECT attribute, count(*) AS k, sum(n) AS n_total, sum(n * m) / sum(n) AS grand,
    sum(coalesce((n - 1) * v, 0.0)) AS ssw FROM mom GROUP BY attribute
),
ss AS (
  SELECT p.attribute, p.k, p.n_total, p.ssw, sum(r.n * (r.m - p.grand) * (r.m - p.grand)) AS ssb
  FROM per p JOIN ranked r USING (attribute) GROUP BY ALL
),
w AS (
  SELECT a.attribute, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t
  FROM ranked a JOIN ranked b ON a.attribute = b.attribute AND a.gi = 1 AND b.gi = 2
)
SELECT ss.attribute, CASE WHEN k = 2 THEN 'welch_t' ELSE 'anova_f' END AS test,
  CASE WHEN k = 2 THEN w.t ELSE (ssb / (k - 1)) / (ssw / (n_total - k)) END AS statistic,
  CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0.0 END AS eta_squared
FROM ss LEFT JOIN w USING (attribute)"""


@register("attribute_tests", _tests_sql(), floats=["statistic", "eta_squared"])
def attribute_tests(spark, sf_dir):
    """Welch t / ANOVA F and eta² of average score per background attribute."""
    return A.attribute_tests(engineered_students(spark, sf_dir))


def _box_sql() -> str:
    src = union_all([f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, average_score AS value "
                     f"FROM eng WHERE average_score IS NOT NULL" for a in CATEGORICAL_COLUMNS])
    # DuckDB's quantile_cont is the same linear rule, computed independently of our rank search
    return ENG.rstrip() + f""",
longv AS ({src})
SELECT attribute, grp, n, mn AS min, q[1] AS q1, q[2] AS median, q[3] AS q3, mx AS max
FROM (SELECT attribute, grp, count(*) AS n, min(value) AS mn, max(value) AS mx,
        quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM longv GROUP BY attribute, grp) b"""


@register("box_by_group", _box_sql(), floats=["min", "q1", "median", "q3", "max"])
def box_by_group(spark, sf_dir):
    """Box-plot numbers of average score per group, ordered by median."""
    return A.box_by_group(engineered_students(spark, sf_dir), CATEGORICAL_COLUMNS)


def _hist_sql(col: str, bins: int, hue: str | None) -> str:
    hsel = f"{hue}, " if hue else ""
    grid = (f"(SELECT DISTINCT {hue} FROM d) h, " if hue else "")
    hj = f"c.{hue} = g.{hue} AND " if hue else ""
    return ENG.rstrip() + f""",
d AS (SELECT {hsel}CAST({col} AS DOUBLE) AS x FROM eng WHERE {col} IS NOT NULL AND NOT isnan({col})),
lim AS (SELECT CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM d),
c AS (
  SELECT {hsel}CAST(least(greatest(floor((x - lo) * ({float(bins)} / (hi - lo))), 0), {bins - 1}) AS INTEGER) AS bin,
    count(*) AS n
  FROM d, lim GROUP BY ALL
),
g AS (SELECT {"h." + hue + ", " if hue else ""}CAST(r.range AS INTEGER) AS bin FROM {grid}range({bins}) r)
SELECT {"g." + hue + ", " if hue else ""}g.bin, lo + g.bin * ((hi - lo) / {float(bins)}) AS bin_lo,
  lo + (g.bin + 1) * ((hi - lo) / {float(bins)}) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN lim LEFT JOIN c ON {hj}c.bin = g.bin"""


@register("histogram", _hist_sql("average_score", 25, None), floats=["bin_lo", "bin_hi"])
def histogram(spark, sf_dir):
    """25 equal-width bins of the average score."""
    return A.histogram(engineered_students(spark, sf_dir), "average_score", 25)


@register("histogram_by_hue", _hist_sql("math_score", 30, "test_preparation_course"),
          floats=["bin_lo", "bin_hi"])
def histogram_by_hue(spark, sf_dir):
    """30 bins of the math score split by test preparation."""
    return A.histogram(engineered_students(spark, sf_dir), "math_score", 30, hue="test_preparation_course")


@register("class_weights", ENG + """
SELECT at_risk, count(*) AS n_c,
  (SELECT count(*) FROM eng) / ((SELECT count(DISTINCT at_risk) FROM eng) * count(*)) AS weight
FROM eng GROUP BY at_risk""", floats=["weight"])
def class_weights(spark, sf_dir):
    """Balanced class weights n / (k · n_c)."""
    return A.class_weights(engineered_students(spark, sf_dir), "at_risk")


def _describe_all_sql() -> str:
    src = union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM students "
                     f"WHERE {c} IS NOT NULL" for c in STUDENT_COLS])
    return with_ctes(STUDENTS).rstrip() + f""",
longv AS ({src}),
vc AS (SELECT column_name, value, count(*) AS c FROM longv GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, value) AS rn FROM vc)
SELECT column_name, CAST(sum(c) AS BIGINT) AS count, count(*) AS unique,
  max(value) FILTER (WHERE rn = 1) AS top, max(c) FILTER (WHERE rn = 1) AS freq
FROM ranked GROUP BY column_name"""


@register("describe_all", _describe_all_sql())
def describe_all(spark, sf_dir):
    """Count / unique / top / freq of every column."""
    s = D.students(spark, sf_dir)
    return A.describe_all(s.select(*[F.col(c).cast("string").alias(c) for c in STUDENT_COLS]))


@register("group_summary", ENG + """
SELECT lunch, count(*) AS n, avg(math_score) AS mean_math_score, avg(reading_score) AS mean_reading_score,
  avg(writing_score) AS mean_writing_score FROM eng GROUP BY lunch""",
          floats=["mean_math_score", "mean_reading_score", "mean_writing_score"])
def group_summary(spark, sf_dir):
    """A3: size and mean scores for one attribute."""
    return A.group_summary(engineered_students(spark, sf_dir), "lunch", list(SCORE_COLUMNS))


@register("score_pairs", ENG + """
SELECT student_id, math_score, reading_score, writing_score, test_preparation_course FROM eng""",
          floats=list(SCORE_COLUMNS))
def score_pairs(spark, sf_dir):
    """The score-pair table with its hue column (every row; plotting is not built)."""
    return engineered_students(spark, sf_dir).select("student_id", *SCORE_COLUMNS, "test_preparation_course")


@register("distinct_groups", ENG + "SELECT DISTINCT CAST(parental_level_of_education AS VARCHAR) AS grp FROM eng")
def distinct_groups(spark, sf_dir):
    """Distinct sorted groups of a column."""
    return A.group_rows(engineered_students(spark, sf_dir), "parental_level_of_education")


@register("rate_by_group", ENG + union_all([
    f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, avg(at_risk) AS rate, "
    f"(SELECT avg(at_risk) FROM eng) AS overall_rate FROM eng GROUP BY {a}" for a in CATEGORICAL_COLUMNS]),
          floats=["rate", "overall_rate"])
def rate_by_group(spark, sf_dir):
    """At-risk rate per group with the overall rate as reference."""
    return A.rate_by_group(engineered_students(spark, sf_dir), CATEGORICAL_COLUMNS)
