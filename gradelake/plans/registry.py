"""Where queries are registered by name, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradelake.operators import gpa
from gradelake.plans.academic import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rounded quotients by the mark that stands for them in the SQL.
RATIOS = {
    "@GP@": gpa.ratio_sql("sum(grade_points * credits)", "sum(credits)", 2),
    "@SG@": gpa.ratio_sql("sum(CASE WHEN status = 'PASS' THEN grade_points * credits ELSE 0 END)", "sum(credits)", 2),
    "@CS@": gpa.ratio_sql("sum(grade_point_sum)", "sum(credits_attempted)", 2),
    "@BM@": gpa.ratio_sql("sum(total_marks)", "sum(max_marks)", 6),
    "@PC@": gpa.ratio_sql("100 * sum(total_marks)", "sum(max_marks)", 2),
    "@PR@": gpa.ratio_sql("100 * count(*) FILTER (WHERE status = 'PASS')", "count(*) FILTER (WHERE status IN ('PASS', 'FAIL'))", 2),
    "@PA@": gpa.ratio_sql("100 * count(*) FILTER (WHERE status = 'PASS')", "count(*)", 2),
    "@MEAN@": gpa.ratio_sql("s", "n * 100", 2),
    "@AVG@": gpa.ratio_sql("sum(total_marks)", "count(*)"),
}
#: Each student's average over rows with points, as a query.
CGPA = "SELECT student_id, @GP@ AS cgpa FROM results JOIN subjects USING (subject_id) WHERE grade_points > 0 GROUP BY 1"
#: Points of a grade and the grade of marks out of 100, as SQL expressions with a {} for the column.
POINTS = "CASE {} WHEN 'O' THEN 10.0 WHEN 'A+' THEN 9.0 WHEN 'A' THEN 8.0 WHEN 'B+' THEN 7.0 WHEN 'B' THEN 6.0 WHEN 'C' THEN 5.0 WHEN 'P' THEN 4.0 WHEN 'F' THEN 0.0 END"
GRADE = "CASE WHEN {0} >= 90 THEN 'O' WHEN {0} >= 80 THEN 'A+' WHEN {0} >= 70 THEN 'A' WHEN {0} >= 60 THEN 'B+' WHEN {0} >= 55 THEN 'B' WHEN {0} >= 50 THEN 'C' WHEN {0} >= 40 THEN 'P' ELSE 'F' END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            filled = sql
            for mark, expression in RATIOS.items():
                filled = filled.replace(mark, expression)
            SQL[name] = with_views(filled)
        return function

    return add
