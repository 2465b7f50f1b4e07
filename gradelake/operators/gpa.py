"""Grade-point averages, backlogs, ranks and statistics over results, as named policies.

Every function takes and returns DataFrames. Points and credits are whole numbers, so sums don't depend on the order
of rows; they are divided and rounded once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """top / bottom of whole numbers (not negative), rounded half up in whole numbers; null where the bottom is 0.

    Rounding a quotient of doubles would depend on the engine where the quotient lies between two results.
    """
    scale = 10**digits
    bottom = F.nullif(bottom.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", 2 * scale * top.cast("long") + bottom, 2 * bottom) / F.lit(float(scale))


def ratio_sql(top: str, bottom: str, digits: int = 4) -> str:
    """``ratio`` in SQL."""
    return f"((({2 * 10**digits} * ({top}) + ({bottom}))::bigint // (2 * nullif({bottom}, 0))::bigint) / {10**digits}.0::double)"


def credited(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Results with their subject's credits (3 where unknown); the subjects are a dimension."""
    return results.join(subjects.select("subject_id", "credits"), "subject_id").withColumn("credits", F.coalesce("credits", F.lit(3)))


def sgpa_standard(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per student and semester: what isn't passed earns no points, its credits still count."""
    return sgpa_by(credited(results, subjects), "student_id", "semester")


def sgpa_by(rows: DataFrame, *keys: str, also: Sequence[Column] = ()) -> DataFrame:
    """``sgpa_standard`` by ``keys`` of results that have their credits, with ``also`` aggregated in the same pass."""
    passed = F.col("status") == "PASS"
    out = rows.groupBy(*keys).agg(
        F.sum("credits").alias("credits_attempted"),
        F.sum(F.when(passed, F.col("credits")).otherwise(0)).alias("credits_earned"),
        F.sum(F.when(passed, F.col("grade_points") * F.col("credits")).otherwise(0)).alias("grade_point_sum"),
        F.count_if(passed).alias("subjects_passed"),
        F.count_if(~passed).alias("subjects_failed"),
        *also,
    )
    return out.withColumn("sgpa", F.coalesce(ratio(F.col("grade_point_sum"), F.col("credits_attempted"), 2), F.lit(0.0)))


def cgpa_standard(semesters: DataFrame) -> DataFrame:
    """Per student, from ``sgpa_standard``'s rows."""
    out = semesters.groupBy("student_id").agg(
        F.count("*").alias("semesters"), F.sum("grade_point_sum").alias("points"), F.sum("credits_attempted").alias("credits"), F.sum("subjects_passed").alias("subjects_passed")
    )
    return out.select("student_id", "semesters", "subjects_passed", F.coalesce(ratio(F.col("points"), F.col("credits"), 2), F.lit(0.0)).alias("cgpa"))


def gpa_positive(results: DataFrame, subjects: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: only rows with grade points above 0 count, in points and in credits."""
    rows = credited(results, subjects).filter("grade_points > 0").groupBy(*keys)
    return rows.agg(ratio(F.sum(F.col("grade_points") * F.col("credits")), F.sum("credits"), 2).alias("gpa"))


def cgpa_latest_pass(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per student: each subject's latest passing attempt, found in the aggregation itself."""
    passed = results.filter("status = 'PASS'").groupBy("student_id", "subject_id").agg(F.max_by("grade_points", "attempt_number").alias("grade_points"))
    return credited(passed, subjects).groupBy("student_id").agg(ratio(F.sum(F.col("grade_points") * F.col("credits")), F.sum("credits"), 2).alias("cgpa"))


def cgpa_with_fallbacks(students: DataFrame, results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per student: the average over positive rows, else of semester averages, else of marks; 0 without any.

    One pass over the fact: sums by student and semester, and from them the student's.
    """
    good = F.col("grade_points") > 0
    known = subjects.select("subject_id", "credits", F.lit(True).alias("known"))
    rows = results.join(known, "subject_id", "left").withColumn("credits", F.when(F.col("known"), F.coalesce("credits", F.lit(3))))
    per = rows.groupBy("student_id", "semester").agg(
        F.sum(F.when(good, F.col("grade_points") * F.col("credits"))).alias("p"), F.sum(F.when(good, F.col("credits"))).alias("c"), F.sum("total_marks").alias("m"), F.sum("max_marks").alias("x")
    )
    own = ratio(F.col("p"), F.col("c"), 2)
    per = per.withColumn("own", F.when(own > 0, own)).groupBy("student_id").agg(
        ratio(F.sum("p"), F.sum("c"), 2).alias("by_points"), F.avg("own").alias("by_semester"), (ratio(F.sum("m"), F.sum("x"), 6) * 10).alias("by_marks")
    )
    value = F.coalesce("by_points", "by_semester", "by_marks", F.lit(0.0))
    return students.select("student_id").join(per, "student_id", "left").select("student_id", F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(10.0)), 2).alias("cgpa"))


def backlogs_any_fail(results: DataFrame) -> DataFrame:
    """Per student: subjects ever failed, and those of them never passed (one aggregation instead of an anti join)."""
    per = results.groupBy("student_id", "subject_id").agg(F.bool_or(F.col("status") == "FAIL").alias("failed"), F.bool_or(F.col("status") == "PASS").alias("passed"))
    return per.groupBy("student_id").agg(F.count_if("failed").alias("total_backlogs"), F.count_if(F.col("failed") & ~F.col("passed")).alias("active_backlogs"))


def backlogs_never_passed(results: DataFrame) -> DataFrame:
    """Per student: subjects never passed, and those failed at every attempt."""
    per = results.groupBy("student_id", "subject_id").agg(F.bool_and(F.col("status") == "FAIL").alias("failed"), F.bool_or(F.col("status") == "PASS").alias("passed"))
    return per.groupBy("student_id").agg(F.count_if(~F.col("passed")).alias("total_backlogs"), F.count_if(F.col("failed") & ~F.col("passed")).alias("active_backlogs"))


def nearest_rank(value: str, share: float) -> Column:
    """The percentile by nearest rank, half to even."""
    ordered = F.array_sort(F.collect_list(value))
    return F.element_at(ordered, (F.bround(F.lit(share) * (F.size(ordered) - 1)) + 1).cast("int"))


def batch_statistics(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, extremes, population deviation and percentiles of a batch.

    Values have two decimals, so a batch's distinct values are few whatever its size: they are counted first, and
    percentiles are read off their running counts.
    """
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("n").over(order)).withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda share: F.min(F.when(F.col("upto") > F.bround(F.lit(share) * (F.col("size") - 1)), F.col(value)))
    v = F.round(F.col(value) * 100).cast("long")
    n, s, q = F.sum("n"), F.sum(v * F.col("n")), F.sum(v * v * F.col("n"))
    variance = (q.cast("double") * n - s.cast("double") * s) / (n.cast("double") * n) / 10000
    return ranked.groupBy(*keys).agg(
        n.alias("n"), ratio(s, n * 100, 2).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 4).alias("deviation"),
        at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"),
    )


def class_rank(students: DataFrame, cgpa: DataFrame, *keys: str) -> DataFrame:
    """Competition rank and class size within ``keys``; a missing average counts as 0.

    Averages have two decimals, so ranks come from the counts of distinct averages, not from one sort of all students.
    """
    rows = students.join(cgpa, "student_id", "left").withColumn("cgpa", F.coalesce("cgpa", F.lit(0.0)))
    counts = rows.groupBy(*keys, "cgpa").agg(F.count("*").alias("n"))
    better = Window.partitionBy(*keys).orderBy(F.desc("cgpa")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("class_rank", 1 + F.coalesce(F.sum("n").over(better), F.lit(0))).withColumn("class_size", F.sum("n").over(Window.partitionBy(*keys))).drop("n")
    return rows.join(ranks, [*keys, "cgpa"])


def report_metrics(results: DataFrame) -> DataFrame:
    """Per student: counts, percentage over known marks, pass rate and number of semesters."""
    known = F.col("total_marks").isNotNull() & F.col("max_marks").isNotNull()
    p, f = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "FAIL")
    return results.groupBy("student_id").agg(
        F.count("*").alias("n_results"), p.alias("passed"), f.alias("failed"), F.count_distinct("semester").alias("semesters"),
        F.coalesce(ratio(100 * F.sum(F.when(known, F.col("total_marks"))), F.sum(F.when(known, F.col("max_marks"))), 2), F.lit(0.0)).alias("percentage"),
        F.coalesce(ratio(100 * p, p + f, 2), F.lit(0.0)).alias("pass_rate"),
    )


def pass_rates(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per subject: attempts, passes and the share of passes."""
    per = results.groupBy("subject_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "PASS").alias("passed"))
    return per.join(subjects.select("subject_id", "code", "name"), "subject_id").withColumn("pass_rate", ratio(100 * F.col("passed"), F.col("attempts"), 2))


def trend(semesters: DataFrame) -> DataFrame:
    """Semester averages with the change since the semester before."""
    before = F.lag("sgpa").over(Window.partitionBy("student_id").orderBy("semester"))
    return semesters.select("student_id", "semester", "sgpa", F.round(F.col("sgpa") - before, 2).alias("change"))
