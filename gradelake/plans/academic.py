"""Students, subjects and results as views over the star schema, the same text for Spark and for DuckDB."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "subjects": """
select p_partkey as subject_id, concat('SUB', lpad(cast(p_partkey as string), 6, '0')) as code,
  p_name as name, 1 + p_size % 4 as credits, 100 as max_marks, 35 as pass_marks from {part}""",
    "students": """
select c_custkey as student_id,
  concat(cast(1 + cast(floor(c_custkey / 1000) as int) % 4 as string), 'MS',
    lpad(cast(20 + cast(floor(c_custkey / 4000) as int) % 10 as string), 2, '0'),
    chr(65 + c_nationkey), 'S', lpad(cast(c_custkey % 1000 as string), 3, '0')) as usn,
  c_name as name, c_nationkey as department_id,
  case when c_custkey % 20 = 0 then 'seed' when c_custkey % 3 = 0 then 'upload' else 'pipeline' end as source
from {customer}""",
    "results": """
select student_id, subject_id, semester, total_marks, 100 as max_marks, attempt_number,
  case when attempt_number > 1 then 'supplementary' else 'regular' end as exam_type,
  case when total_marks >= 90 then 'O' when total_marks >= 80 then 'A+' when total_marks >= 70 then 'A'
    when total_marks >= 60 then 'B+' when total_marks >= 55 then 'B' when total_marks >= 50 then 'C'
    when total_marks >= 40 then 'P' else 'F' end as grade,
  case when total_marks >= 90 then 10 when total_marks >= 80 then 9 when total_marks >= 70 then 8
    when total_marks >= 60 then 7 when total_marks >= 55 then 6 when total_marks >= 50 then 5
    when total_marks >= 40 then 4 else 0 end as grade_points,
  case when l_returnflag = 'A' and l_linestatus = 'O' and l_tax >= 0.07 then 'ABSENT'
    when total_marks >= 40 then 'PASS' else 'FAIL' end as status
from (select o_custkey as student_id, l_partkey as subject_id, year(o_orderdate) - 1994 as semester,
    cast(l_quantity * 2 as int) as total_marks, l_returnflag, l_linestatus, l_tax,
    row_number() over (partition by o_custkey, l_partkey
      order by o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) as attempt_number
  from {lineitem} join {orders} on l_orderkey = o_orderkey) t""",
}
_INPUTS = {"subjects": ("part",), "students": ("customer",), "results": ("lineitem", "orders")}


class Academic(NamedTuple):
    """The three views as DataFrames."""

    students: DataFrame
    subjects: DataFrame
    results: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, until: int | None = None) -> DataFrame:
    """One of the views; of the results those up to the semester ``until``.

    Attempts are numbered by date first, so later ones, which would be dropped, change no earlier number.
    """
    inputs = {t: table(spark, sf_dir, t) for t in _INPUTS[name]}
    if name == "results" and until is not None:
        inputs["orders"] = inputs["orders"].filter(F.col("o_orderdate").isNull() | (F.year("o_orderdate") - 1994 <= until))  # without a date they are numbered first
        return spark.sql(VIEWS[name], **inputs).filter(F.col("semester") <= until)
    return spark.sql(VIEWS[name], **inputs)


def academic(spark: SparkSession, sf_dir: str, until: int | None = None) -> Academic:
    """All three views."""
    return Academic(*(view(spark, sf_dir, n, until) for n in Academic._fields))


def own_code(subject_id: Column) -> Column:
    """A subject's code with all its digits: the view's code keeps the first six and is shared from a million subjects on."""
    return F.concat(F.lit("SUB"), F.format_string("%06d", subject_id))


def own_usn(usn: Column, student_id: Column) -> Column:
    """A student number of one's own: the view's repeats every 40000 students, each next round gets two letters more."""
    turn = F.floor(student_id / 40000)
    letters = F.concat(F.chr(F.lit(65) + F.floor(turn / 26) % 26), F.chr(F.lit(65) + turn % 26))
    return F.when(turn > 0, F.concat(F.substring(usn, 1, 7), letters, F.substring(usn, 8, 3))).otherwise(usn)


def shared_usn(number: Column) -> Column:
    """The view's student number of ``own_usn``."""
    return F.regexp_replace(number, r"^(.{7})[A-Z]{2}(\d{3})$", "$1$2")


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views it names as leading CTEs."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in _INPUTS[n]})})" for n in Academic._fields if n in sql]
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if body[:4].upper() == "WITH":
        body = ", " + body[14 if recursive else 4 :].strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " + body if parts else sql
