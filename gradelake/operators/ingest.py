"""Persistence of what was extracted: results, semester aggregates, messages, uploads, deletions, as snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import mail_date, normal_name, subject_code
from gradelake.operators import gpa
from gradelake.operators.writes import always, credits_rule, keep, last_by_key, merge_upsert, newest, source_rule

#: What a result, a message and an attachment can be.
RESULT_STATUSES = ("PASS", "FAIL", "ABSENT", "WITHHELD")
EXAM_TYPES = ("regular", "supplementary", "improvement")
MESSAGE_STATUSES = ("pending", "processing", "completed", "failed", "quarantined", "skipped", "processed_no_records", "queued_for_review")
PARSE_STATUSES = ("pending", "processing", "completed", "failed", "quarantined")
PASS_MARKS = 35
RESULT_KEY = ("student_id", "subject_id", "semester", "exam_type", "attempt_number")


def result_changes(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows as results to be stored: a missing status follows from points (4) or the subject's pass marks (35 if unknown).

    An unknown status counts as PASS, an unknown kind of exam as regular; marks become whole numbers, none become 0.
    """
    limits = subjects.select("subject_id", F.col("pass_marks").alias("least"))
    marks = F.coalesce("marks", F.lit(0))
    passed = (F.coalesce("grade_points", F.lit(0)) >= 4) | (marks >= F.coalesce("least", F.lit(PASS_MARKS)))
    status = F.upper("status")
    status = F.when(F.col("status").isNull(), F.when(passed, "PASS").otherwise("FAIL")).when(status.isin(*RESULT_STATUSES), status).otherwise("PASS")
    exam = F.lower(F.coalesce("exam_type", F.lit("regular")))
    return rows.join(limits, "subject_id", "left").select(
        "student_id", "subject_id", "semester", F.when(exam.isin(*EXAM_TYPES), exam).otherwise("regular").alias("exam_type"), F.coalesce("attempt_number", F.lit(1)).alias("attempt_number"),
        marks.cast("int").alias("total_marks"), F.coalesce("max_marks", F.lit(100)).cast("int").alias("max_marks"), "grade", F.col("grade_points").cast("double").alias("grade_points"), status.alias("status"),
    )


def upsert_results(results: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot of results; ``changes`` has one row a key. Marks and status are always new, the maximum is never."""
    return merge_upsert(results, changes, list(RESULT_KEY), {"total_marks": newest, "max_marks": keep, "grade": newest, "grade_points": newest, "status": always})


def semester_changes(averages: DataFrame, results: DataFrame) -> DataFrame:
    """Aggregates to be stored for ``averages`` (student_id, semester, sgpa, credits_earned), with counts of their results.

    Only the results of the students and semesters named are counted.
    """
    key = ["student_id", "semester"]
    counted = results.join(averages.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count_if(F.col("status") == "PASS").alias("subjects_passed"), F.count_if(F.col("status") == "FAIL").alias("subjects_failed"))
    earned = F.coalesce("credits_earned", F.lit(0)).cast("int")
    rows = averages.join(counted, key, "left").select(*key, F.nullif(F.col("sgpa").cast("double"), F.lit(0.0)).alias("sgpa"), earned.alias("credits_earned"), earned.alias("credits_attempted"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("subjects_passed", "subjects_failed")))
    return rows.withColumn("backlogs", F.col("subjects_failed"))


def upsert_semesters(aggregates: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot of semester aggregates; attempted credits are those of the first time."""
    rules = {c: always for c in ("sgpa", "credits_earned", "subjects_passed", "subjects_failed", "backlogs")}
    return merge_upsert(aggregates, changes, ["student_id", "semester"], {**rules, "credits_attempted": keep})


def upsert_students(students: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot of students by number; a real source stays."""
    return merge_upsert(students, changes, ["usn"], {"name": newest, "email": newest, "source": source_rule})


def upsert_subjects(subjects: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot of subjects by code; credits and pass marks are at least 1, 3 credits mean unspecified."""
    safe = changes.withColumns({"code": F.upper("code"), "name": F.nullif("name", F.lit("")), "credits": F.greatest(F.coalesce("credits", F.lit(3)), F.lit(1)), "pass_marks": F.greatest("pass_marks", F.when(F.col("pass_marks").isNotNull(), 1))})
    return merge_upsert(subjects, safe, ["code"], {"name": newest, "credits": credits_rule, "pass_marks": newest})


def record_subjects(records: DataFrame) -> DataFrame:
    """Subject rows of records (usn, name, semester, subjects), with codes made up where they are missing.

    Numbers of fewer than five characters are left out. What says PASS is a pass, anything else (ABSENT too) a fail. A
    subject without code and name gets one from its marks.
    """
    usn = F.upper(F.trim("usn"))
    rows = records.filter(F.length(usn) >= 5).select(usn.alias("usn"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), usn).alias("name"), F.coalesce("semester", F.lit(1)).alias("semester"), F.posexplode("subjects").alias("at", "s"))
    code, name = F.upper(F.trim(F.coalesce("s.code", F.lit("")))), F.trim(F.coalesce("s.name", F.lit("")))
    marks = F.coalesce("s.marks", F.lit(0))
    nameless = F.concat(F.lit("SUBJ"), F.lpad((F.crc32(marks.cast("string").cast("binary")) % 1000).cast("string"), 3, "0"))
    made = F.when(code != "", code).when(name != "", subject_code(name)).otherwise(nameless)
    return rows.select(
        "usn", "name", "semester", "at", made.alias("code"), F.coalesce(F.nullif(name, F.lit("")), made).alias("subject_name"), F.nullif(marks, F.lit(0)).alias("marks"), F.coalesce(F.nullif("s.max_marks", F.lit(0)), F.lit(100)).alias("max_marks"),
        F.coalesce("s.grade", F.lit("")).alias("grade"), F.nullif(F.col("s.grade_points").cast("double"), F.lit(0.0)).alias("grade_points"), F.when(F.upper("s.status").contains("PASS"), "PASS").otherwise("FAIL").alias("status"),
    )


def save_records(records: DataFrame, tables: dict[str, DataFrame], pre_clean: bool = False, cleaned_by: Callable[[Column], Column] = lambda usn: usn) -> dict[str, DataFrame]:
    """The next snapshots of students, subjects, results and averages after records are stored.

    ``tables`` has students (usn, name, email, source), subjects (subject_id and code, the same here, name, credits,
    pass_marks), results (student_id is the usn) and averages (student_id, cgpa). With ``pre_clean``, earlier results of
    each student and semester that the records name go first; ``cleaned_by`` gives what students have in common whose
    results go together. Of a result told twice, the last one in its record counts.
    Averages are worked out again for the students named alone.
    """
    rows = record_subjects(records)
    students = upsert_students(tables["students"], rows.groupBy("usn").agg(F.max("name").alias("name")).withColumns({"email": F.lit(None).cast("string"), "source": F.lit("pipeline")}))
    told = rows.groupBy("code").agg(F.max("subject_name").alias("name")).withColumns({"credits": F.lit(3), "pass_marks": F.lit(None).cast("int"), "subject_id": F.col("code")})
    subjects = upsert_subjects(tables["subjects"], told).withColumn("subject_id", F.coalesce("subject_id", "code"))
    fresh = rows.withColumns({"student_id": F.col("usn"), "subject_id": F.col("code"), "exam_type": F.lit("SEE"), "attempt_number": F.lit(1)})
    changes = last_by_key(result_changes(fresh, subjects).join(fresh.select("student_id", "subject_id", "semester", "at").groupBy("student_id", "subject_id", "semester").agg(F.max("at").alias("at")), ["student_id", "subject_id", "semester"]), list(RESULT_KEY), "at").drop("at")
    old = tables["results"]
    if pre_clean:
        named = records.filter(F.length(F.trim("usn")) >= 5).select(cleaned_by(F.upper(F.trim("usn"))).alias("_by"), F.coalesce("semester", F.lit(1)).alias("semester")).distinct()
        old = old.withColumn("_by", cleaned_by(F.col("student_id"))).join(named, ["_by", "semester"], "left_anti").select(old.columns)
    results = upsert_results(old, changes)
    compute = lambda r: gpa.gpa_positive(r, subjects, "student_id").withColumnRenamed("gpa", "cgpa")
    affected = changes.select("student_id").distinct()
    averages = tables["averages"].join(affected, "student_id", "left_anti").unionByName(compute(results.join(affected, "student_id", "left_semi")))
    return {"students": students, "subjects": subjects, "results": results, "averages": averages}


def upload_changes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded rows as (averages, results): without a subject code they tell an average, with one a result.

    A result without a status is a pass from 40 marks on.
    """
    good = rows.withColumn("student_id", F.upper(F.trim("usn"))).filter("student_id <> ''")
    average = good.filter(F.col("code").isNull() & (F.col("sgpa") > 0)).groupBy("student_id", F.coalesce("semester", F.lit(1)).alias("semester")).agg(F.max("sgpa").alias("sgpa")).withColumn("credits_earned", F.lit(0))
    marks = F.coalesce("marks", F.lit(0.0))
    status = F.upper(F.coalesce("status", F.when(marks >= 40, "PASS").otherwise("FAIL")))
    result = good.filter(F.col("code").isNotNull()).select("student_id", F.trim("code").alias("subject_id"), F.coalesce("semester", F.lit(1)).alias("semester"), marks.alias("marks"), F.coalesce(F.nullif("max_marks", F.lit(0.0)), F.lit(100.0)).alias("max_marks"), F.nullif(F.trim("grade"), F.lit("")).alias("grade"), F.lit(None).cast("double").alias("grade_points"), status.alias("status"), F.lit("regular").alias("exam_type"), F.lit(1).alias("attempt_number"))
    return average, result


def message_changes(mails: DataFrame, now: Column) -> DataFrame:
    """Messages to be stored: the body's hash (zeros without a body), the date read from its header (else ``now``)."""
    body = F.when(F.coalesce(F.col("body"), F.lit("")) != "", F.sha2("body", 256)).otherwise("0" * 64)
    return mails.select(
        "message_id", "subject", F.coalesce("sender", F.lit("unknown@unknown")).alias("sender"), F.coalesce(mail_date(F.col("date")), now).alias("received_at"), body.alias("body_hash"),
        F.coalesce("raw_path", F.lit("unknown")).alias("raw_path"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("classification"),
    )


def upsert_messages(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot of messages by id: subject and path follow new values, the rest stays as first told."""
    rules = {c: keep for c in messages.columns if c not in ("message_id", "subject", "raw_path")}
    return merge_upsert(messages, changes, ["message_id"], {**rules, "subject": newest, "raw_path": newest})


def with_statuses(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """Messages after status updates (message_id, new_status); a status that there isn't counts as completed."""
    new = updates.select("message_id", F.when(F.col("new_status").isin(*MESSAGE_STATUSES), F.col("new_status")).otherwise("completed").alias("new_status"))
    return messages.join(new, "message_id", "left").withColumn("status", F.coalesce("new_status", "status")).select(*messages.columns)


def attachment_updates(attachments: DataFrame, updates: DataFrame) -> DataFrame:
    """Attachments after updates (attachment_id, parse_status, page_count, document_type, metadata): metadata is merged key by key, new values win."""
    new = updates.select("attachment_id", *(F.col(c).alias(f"new_{c}") for c in ("parse_status", "page_count", "document_type", "metadata")))
    rows = attachments.join(new, "attachment_id", "left")
    there = F.col("new_parse_status").isNotNull()
    status = F.when(there, F.when(F.col("new_parse_status").isin(*PARSE_STATUSES), F.col("new_parse_status")).otherwise("pending")).otherwise(F.col("parse_status"))
    out = {"parse_status": status, "page_count": F.coalesce("new_page_count", "page_count"), "document_type": F.coalesce("new_document_type", "document_type"), "metadata": merged_map(F.col("metadata"), F.col("new_metadata"))}
    return rows.withColumns(out).select(*attachments.columns)


def merged_map(old: Column, new: Column) -> Column:
    """Two maps as one; where both have a key the new value counts."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def appended(rows: DataFrame, path: str, day: str) -> None:
    """Add rows to a log that is partitioned by the day of ``day``; earlier rows are never touched."""
    rows.withColumn("day", F.col(day).cast("date")).write.mode("append").partitionBy("day").parquet(path)


def without_source(tables: dict[str, DataFrame], sources: tuple[str | None, ...] = ("seed",)) -> dict[str, DataFrame]:
    """Students of the given sources (None: without one) gone with their results and aggregates, then subjects that no result has."""
    named = F.col("source").isin(*(s for s in sources if s is not None))
    gone = tables["students"].filter((named | F.col("source").isNull()) if None in sources else named).select("student_id")
    left = {name: tables[name].join(gone, "student_id", "left_anti") for name in ("students", "results", "aggregates")}
    return {**left, "subjects": tables["subjects"].join(left["results"].select("subject_id").distinct(), "subject_id", "left_semi")}


def emptied(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without rows, their columns as before."""
    return {name: df.limit(0) for name, df in tables.items()}


def quarantined(attachments: DataFrame, unsafe: Column) -> tuple[DataFrame, DataFrame]:
    """Attachments that may go on, and those that are set aside."""
    bad = F.coalesce(unsafe, F.lit(True))
    return attachments.filter(~bad), attachments.filter(bad).withColumn("parse_status", F.lit("quarantined"))


__all__ = ["appended", "attachment_updates", "emptied", "merged_map", "message_changes", "normal_name", "quarantined", "record_subjects", "result_changes", "save_records", "semester_changes", "upload_changes", "upsert_messages", "upsert_results", "upsert_semesters", "upsert_students", "upsert_subjects", "with_statuses", "without_source"]
