"""DuckDB definitions of the derived inputs (same meaning as ``sources.derived``)."""

from cohortlens.functions.domain import ETHNICITIES, PARENTAL_EDUCATION


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STUDENTS = f"""
students AS (
  SELECT
    o.o_orderkey AS student_id,
    CASE WHEN o.o_orderkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
    {_list(ETHNICITIES)}[r.r_regionkey + 1] AS race_ethnicity,
    {_list(PARENTAL_EDUCATION)}[(o.o_custkey % 6) + 1] AS parental_level_of_education,
    CASE WHEN o.o_orderstatus = 'F' THEN 'free/reduced' ELSE 'standard' END AS lunch,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'completed' ELSE 'none' END
      AS test_preparation_course,
    CAST(least(100, 40 + (o.o_orderkey * 7919) % 41
         + CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 6 END
         + CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE 0 END
         + (o.o_orderkey * 31) % 17) AS DOUBLE) AS math_score,
    CAST(least(100, 40 + (o.o_orderkey * 7919) % 41
         + CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 6 END
         + CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE 0 END
         + (o.o_orderkey * 57) % 13) AS DOUBLE) AS reading_score,
    CAST(least(100, 40 + (o.o_orderkey * 7919) % 41
         + CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 6 END
         + CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE 0 END
         + (o.o_orderkey * 73) % 11) AS DOUBLE) AS writing_score
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

STUDENTS_DIRTY = """
dirty0 AS (
  SELECT student_id,
    CASE WHEN student_id % 101 = 0 THEN 'unknown'
         WHEN student_id % 7 = 0 THEN upper(gender) || '  '
         ELSE gender END AS gender,
    race_ethnicity, parental_level_of_education, lunch, test_preparation_course,
    CASE WHEN student_id % 103 = 0 THEN 140.0::DOUBLE ELSE math_score END AS math_score,
    reading_score, writing_score
  FROM students
),
dirty AS (
  SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE student_id % 50 = 0
)"""

def _clean(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


CLEANED = f"""
cleaned AS (
  SELECT DISTINCT student_id,
    {_clean('gender')} AS gender,
    CASE WHEN regexp_matches({_clean('race_ethnicity')}, '^group ([a-e])$')
         THEN 'group ' || upper(regexp_extract({_clean('race_ethnicity')}, '^group ([a-e])$', 1))
         ELSE {_clean('race_ethnicity')} END AS race_ethnicity,
    {_clean('parental_level_of_education')} AS parental_level_of_education,
    {_clean('lunch')} AS lunch,
    {_clean('test_preparation_course')} AS test_preparation_course,
    math_score, reading_score, writing_score
  FROM dirty
)"""

_k = "((math_score IS NOT NULL)::INT + (reading_score IS NOT NULL)::INT + (writing_score IS NOT NULL)::INT)"
_t = "(coalesce(math_score, 0.0) + coalesce(reading_score, 0.0) + coalesce(writing_score, 0.0))"

ENGINEERED = f"""
eng0 AS (
  SELECT *, {_t} AS total_score, {_k} AS k_scores,
    CASE WHEN {_k} > 0 THEN {_t} / {_k} END AS mean_raw,
    least(math_score, reading_score, writing_score) AS min_score,
    greatest(math_score, reading_score, writing_score) AS max_score
  FROM students
),
eng1 AS (
  SELECT *,
    round_even(mean_raw * 100.0, 0) / 100.0 AS average_score,
    CASE WHEN k_scores >= 2 THEN round_even(sqrt((
        coalesce((math_score - mean_raw) * (math_score - mean_raw), 0.0)
      + coalesce((reading_score - mean_raw) * (reading_score - mean_raw), 0.0)
      + coalesce((writing_score - mean_raw) * (writing_score - mean_raw), 0.0)) / (k_scores - 1)) * 100.0, 0) / 100.0
    END AS score_std,
    max_score - min_score AS score_range,
    coalesce(math_score >= 40.0, false)::INT AS pass_math,
    coalesce(reading_score >= 40.0, false)::INT AS pass_reading,
    coalesce(writing_score >= 40.0, false)::INT AS pass_writing
  FROM eng0
),
eng AS (
  SELECT student_id, gender, race_ethnicity, parental_level_of_education, lunch,
    test_preparation_course, math_score, reading_score, writing_score,
    total_score, average_score, score_std, min_score, max_score, score_range,
    pass_math, pass_reading, pass_writing,
    pass_math + pass_reading + pass_writing AS n_passed,
    (pass_math + pass_reading + pass_writing = 3)::INT AS all_passed,
    CASE WHEN average_score < 60.0 THEN 'low' WHEN average_score < 80.0 THEN 'medium'
         WHEN average_score IS NOT NULL THEN 'high' END AS performance_level,
    coalesce(average_score < 60.0, false)::INT AS at_risk,
    CAST(list_position({_list(PARENTAL_EDUCATION)}, parental_level_of_education) - 1 AS INTEGER)
      AS parental_education_rank
  FROM eng1
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


SCORED = """
scored AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    (l_extendedprice / 105000.0::DOUBLE) * 0.7::DOUBLE
      + CASE WHEN l_returnflag = 'R' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS proba,
    l_quantity / 50.0::DOUBLE AS proba_tied,
    l_linestatus AS line_status,
    CAST(l_linenumber AS VARCHAR) AS line_no,
    l_extendedprice AS y_reg,
    l_quantity * 2100.0::DOUBLE AS pred_reg,
    CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS y_cls,
    l_linenumber % 3 AS pred_cls,
    (l_discount + 0.01::DOUBLE) / (((l_discount + 0.01::DOUBLE) + (l_tax + 0.01::DOUBLE)) + l_quantity / 500.0::DOUBLE) AS prob_a,
    (l_tax + 0.01::DOUBLE) / (((l_discount + 0.01::DOUBLE) + (l_tax + 0.01::DOUBLE)) + l_quantity / 500.0::DOUBLE) AS prob_n,
    (l_quantity / 500.0::DOUBLE) / (((l_discount + 0.01::DOUBLE) + (l_tax + 0.01::DOUBLE)) + l_quantity / 500.0::DOUBLE) AS prob_r,
    l_shipdate
  FROM lineitem
)"""

AUDIT_DOCS = """
audit_docs AS (
  SELECT d.doc_id, d.lang, d.source, l.quality AS y, l.toxic,
    1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + CAST(d.n_chars AS DOUBLE) / 5000.0::DOUBLE) AS proba
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
