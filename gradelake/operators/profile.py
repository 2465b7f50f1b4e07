"""What users ask to see: profiles, lists, inboxes, threads, checks of claims, and who may see what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import USN, batch_year, department
from gradelake.operators import gpa

REAL_SOURCES = ("pipeline", "upload")


def visible(students: DataFrame, bag: str | None = None) -> DataFrame:
    """Students from a real source: by the column ``source``, or by that key of the JSON text in ``bag`` if it is there at all."""
    source = F.get_json_object(bag, "$.source") if bag else F.col("source")
    return students.filter(source.isNotNull() & source.isin(*REAL_SOURCES))


def secured(df: DataFrame, students: DataFrame, users: DataFrame, user_id: Column) -> DataFrame:
    """The rows of ``df`` (student_id) that a user may see: those of students of their department, all for admins and principals."""
    me = users.filter(F.col("id") == user_id)
    boss = me.filter(F.col("role").isin("admin", "principal")).select(F.lit(True).alias("all"))
    mine = students.join(me.select("department_id"), "department_id", "left_semi").select("student_id")
    return df.join(mine.unionByName(students.select("student_id").join(boss, F.lit(True), "left_semi")).distinct(), "student_id", "left_semi")


def profiles(students: DataFrame, results: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per student: number, name, department, year, average, backlogs, results, rank among visible students, and how many these are.

    Ranks come from the counts of distinct averages of visible students; the student looked up need not be one of them.
    """
    cgpa = gpa.gpa_positive(results, subjects, "student_id").withColumnRenamed("gpa", "cgpa")
    rows = students.join(cgpa, "student_id", "left").withColumn("cgpa", F.coalesce("cgpa", F.lit(0.0)))
    counts = rows.groupBy("cgpa").agg(F.count_if(F.col("source").isin(*REAL_SOURCES)).alias("n"))
    better = Window.orderBy(F.desc("cgpa")).rowsBetween(Window.unboundedPreceding, -1)  # over distinct averages: at most 1001 rows
    ranks = counts.select("cgpa", (1 + F.coalesce(F.sum("n").over(better), F.lit(0))).alias("class_rank"), F.sum("n").over(Window.partitionBy()).alias("total_students"))
    n = results.groupBy("student_id").agg(F.count("*").alias("total_results"))
    out = rows.join(F.broadcast(ranks), "cgpa").join(gpa.backlogs_any_fail(results), "student_id", "left").join(n, "student_id", "left")
    return out.select(
        "usn", "name", department(F.col("usn")).alias("department"), batch_year(F.col("usn")).alias("batch_year"), "cgpa", F.coalesce("active_backlogs", F.lit(0)).alias("active_backlogs"),
        F.coalesce("total_results", F.lit(0)).alias("total_results"), "class_rank", "total_students",
    )


def results_by_semester(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per student and semester with its results as an array ordered by subject code."""
    rows = results.join(subjects.select("subject_id", "code", F.col("name").alias("subject_name")), "subject_id")
    item = F.struct("code", "attempt_number", "subject_name", F.col("total_marks").alias("marks_obtained"), "max_marks", "grade", "grade_points", F.col("status").alias("pass_status"))
    return rows.groupBy("student_id", F.col("semester").cast("string").alias("semester")).agg(F.sort_array(F.collect_list(item)).alias("results"))


def results_of(results: DataFrame, students: DataFrame, subjects: DataFrame, usn: str, semester: int | None = None) -> DataFrame:
    """A student's results, of one semester where it is given, by semester and code."""
    rows = results.join(students.filter(F.upper("usn") == usn.upper()).select("student_id", "usn"), "student_id").join(subjects.select("subject_id", "code"), "subject_id")
    rows = rows if semester is None else rows.filter(F.col("semester") == semester)
    return rows.select("usn", "semester", "code", "attempt_number", F.col("total_marks").alias("marks_obtained"), "grade", F.col("status").alias("pass_status")).orderBy("semester", "code", "attempt_number")


def top_by(students: DataFrame, results: DataFrame, subjects: DataFrame, metric: str = "cgpa", limit: int = 10) -> DataFrame:
    """The best students by cgpa, by the latest semester's sgpa, or by total_backlogs (most first); ties by number."""
    if metric == "sgpa":
        per = gpa.sgpa_standard(results, subjects).groupBy("student_id").agg(F.max_by("sgpa", "semester").alias(metric))
    elif metric == "total_backlogs":
        per = gpa.backlogs_any_fail(results).select("student_id", metric)
    else:
        metric = "cgpa"
        per = gpa.gpa_positive(results, subjects, "student_id").withColumnRenamed("gpa", metric)
    return students.join(per.filter(F.col(metric).isNotNull()), "student_id").select("usn", "name", metric).orderBy(F.desc(metric), "usn").limit(limit)


def backlog_list(students: DataFrame, results: DataFrame, limit: int | None = 50) -> DataFrame:
    """Visible students with backlogs, most first."""
    per = gpa.backlogs_any_fail(results).filter("total_backlogs > 0")
    rows = visible(students).join(per, "student_id").select("usn", "name", "total_backlogs").orderBy(F.desc("total_backlogs"), "usn")
    return rows if limit is None else rows.limit(limit)


def holds(query: str, *columns: str) -> Column:
    """Whether any of the columns holds a string, in any case."""
    return reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower()) for c in columns))


def inbox(mails: DataFrame, messages: DataFrame, query: str = "", classification: str = "") -> DataFrame:
    """Cached mails with what is stored of them (unknown where nothing is), filtered by class and by a string in any of four fields."""
    told = messages.select(F.col("message_id").alias("known_id"), "classification", F.col("status").alias("pipeline_status"))
    rows = mails.join(told, mails["message_id"] == told["known_id"], "left").drop("known_id")
    rows = rows.withColumns({"classification": F.when(F.col("pipeline_status").isNull(), "unknown").otherwise(F.col("classification")), "pipeline_status": F.coalesce("pipeline_status", F.lit(""))})
    rows = rows.filter(F.col("classification") == classification) if classification else rows
    return rows.filter(holds(query, "subject", "sender", "snippet", "body")) if query else rows


def thread_list(mails: DataFrame, threads: DataFrame, query: str = "", limit: int = 20) -> DataFrame:
    """Threads, newest root first by its date as written, each with its messages' ids in ascending order of date.

    ``threads`` has message_id and root. Messages are filtered before they are put into threads.
    """
    rows = mails.filter(holds(query, "subject", "sender", "body")) if query else mails
    rows = rows.select("message_id", "date").join(threads.select("message_id", "root"), "message_id")
    grouped = rows.groupBy("root").agg(F.max(F.when(F.col("message_id") == F.col("root"), F.col("date"))).alias("date"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "message_id"))), lambda m: m["message_id"]), ",").alias("messages"), F.count("*").alias("n_messages"))
    return grouped.orderBy(F.desc_nulls_last("date"), "root").limit(limit)


def recent_extractions(extractions: DataFrame, messages: DataFrame, limit: int = 10) -> DataFrame:
    """The newest extractions with the subject and sender of their message."""
    told = messages.select(F.col("message_id").alias("email_id"), F.col("subject").alias("email_subject"), "sender")
    return extractions.join(told, "email_id").orderBy(F.desc("created_at"), "extraction_id").limit(limit)


def stored_students(records: DataFrame, students: DataFrame, *also: str) -> DataFrame:
    """The stored rows of the students that records name by number, and by the columns ``also`` where students share numbers."""
    return students.join(records.select(F.upper(F.trim("usn")).alias("usn"), *also).distinct(), ["usn", *also], "left_semi")


def claims_in(replies: DataFrame, key: str, text: str) -> DataFrame:
    """What a reply says near each student number: the first number of one or two decimals up to 10, from 80 characters before it to 140 after its start."""
    usns = F.array_distinct(F.regexp_extract_all(F.upper(F.col(text)), F.lit(rf"\b({USN})\b"), F.lit(1)))
    rows = replies.select(key, F.col(text).alias("said"), F.posexplode(usns).alias("at", "usn"))
    start = F.expr("locate(usn, upper(said))")
    near = F.substring("said", F.greatest(start - 80, F.lit(1)), F.when(start > 80, F.lit(220)).otherwise(start + 139))
    numbers = F.transform(F.regexp_extract_all(near, F.lit(r"\b(\d+\.\d{1,2})\b"), F.lit(1)), lambda n: n.cast("double"))
    return rows.select(key, "at", "usn", F.filter(numbers, lambda n: (n > 0) & (n <= 10)).alias("numbers"))


def checked_claims(claims: DataFrame, averages: DataFrame, key: str, tolerance: float = 0.15, on: tuple[str, ...] = ("usn",)) -> DataFrame:
    """Each claim with its verdict: not_found, mismatch (with the first number that is off), or ok. ``averages``: ``on``, cgpa.

    Where students share numbers, ``on`` names what tells them apart too.
    """
    rows = claims.join(averages.select(*on, F.col("cgpa").alias("actual"), F.lit(True).alias("there")), list(on), "left")
    off = F.get(F.filter("numbers", lambda n: F.abs(n - F.col("actual")) > tolerance), F.lit(0))
    wrong = F.col("actual").isNotNull() & (F.col("actual") != 0) & off.isNotNull()
    return rows.select(key, "usn", F.when(wrong, off).alias("claimed"), "actual", F.when(F.col("there").isNull(), "not_found").when(wrong, "mismatch").otherwise("ok").alias("verdict"))


def pipeline_stats(students: DataFrame, results: DataFrame, subjects: DataFrame, messages: DataFrame, extractions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Ten figures over all tables in one row: each table is aggregated once."""
    cgpa = gpa.gpa_positive(results, subjects, "student_id").filter("gpa > 0")
    seen = visible(students).select("student_id")
    mean = cgpa.join(seen, "student_id", "left_semi").agg(F.coalesce(F.round(F.avg(F.col("gpa").cast("decimal(6,2)")), 2).cast("double"), F.lit(0.0)).alias("average_cgpa"))
    backlogs = gpa.backlogs_any_fail(results).join(seen, "student_id", "left_semi").agg(F.coalesce(F.sum("total_backlogs"), F.lit(0)).alias("total_backlogs"))
    source = F.col("source")
    parts = [
        students.agg(F.count_if(source.isin(*REAL_SOURCES)).alias("total_students"), F.count_if(source == "pipeline").alias("email_students"), F.count_if(source == "upload").alias("admin_students")),
        results.join(seen, "student_id", "left_semi").agg(F.count("*").alias("total_results")),
        extractions.join(messages.select(F.col("message_id").alias("email_id")), "email_id", "left_semi").agg(F.count("*").alias("email_extractions")),
        uploads.agg(F.count("*").alias("admin_upload_files")),
        messages.agg(F.count("*").alias("emails_processed"), F.count_if(F.col("classification") == "result_email").alias("result_emails")),
        backlogs,
        mean,
    ]
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, the way rows go out."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
