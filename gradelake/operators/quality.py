"""Validation, repair, merging and review of result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.grades import SCALE_8, SCALE_10, clamp, grade_of_marks, grade_of_points, points
from gradelake.functions.text import USN
from gradelake.operators import gpa

#: How far each way of extraction is trusted; the first name that a strategy's name holds counts.
WEIGHTS = {"universal_llm": 0.90, "enhanced_llm": 0.85, "llm": 0.80, "document_parser": 0.75, "text_regex": 0.65, "csv_format": 0.70}
OTHER_WEIGHT = 0.60
#: What records of several semesters from a model are worth.
SEMESTERS_CONFIDENCE = {"universal_llm": 0.95, "enhanced_llm": 0.90, "llm": 0.85}
REVIEW_BELOW = 0.65
STATUSES = ("PASS", "FAIL", "ABSENT", "WITHHELD")


def strategy_weight(strategy: Column) -> Column:
    """How far a strategy is trusted."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in WEIGHTS.items():
        out = out.when(strategy.contains(name), F.lit(weight))
    return out.otherwise(F.lit(OTHER_WEIGHT))


def usn_problem(usn: Column) -> Column:
    """What is wrong with a student number; null if nothing."""
    missing = usn.isNull() | (F.trim(usn) == "") | (F.upper(usn) == "UNKNOWN")
    return F.when(missing, "missing_usn").when(~F.upper(F.trim(usn)).rlike(f"^{USN}$"), F.concat(F.lit("invalid_usn_format:"), usn))


def whole(value: Column) -> Column:
    """A number, or text that is one, cut toward zero."""
    return F.trim(value.cast("string")).try_cast("double").try_cast("int")


def _least_pass(maximum: Column, pass_marks: Column | None) -> Column:
    least = F.floor(maximum * 0.4).cast("int")
    return least if pass_marks is None else F.coalesce(F.nullif(whole(pass_marks), F.lit(0)), least)


def subject_problems(marks: Column, maximum: Column, grade: Column, gp: Column, status: Column, pass_marks: Column | None = None) -> Column:
    """All that is wrong with a subject row, as an array of messages."""
    m, top = whole(marks), F.coalesce(F.nullif(whole(maximum), F.lit(0)), F.lit(100))
    g, s = F.upper(F.trim(F.coalesce(grade, F.lit("")))), F.upper(F.coalesce(status, F.lit("")))
    number = F.trim(gp.cast("string")).try_cast("double")
    derived = F.when(m >= _least_pass(top, pass_marks), "PASS").otherwise("FAIL")
    checks = F.array(
        F.when(m.isNull(), "marks_not_numeric").when(~m.between(0, top), "marks_out_of_range"),
        F.when(g.rlike(r"\d"), "grade_contains_digit").when((g != "") & points(g).isNull(), "invalid_grade"),
        F.when(gp.isNotNull() & number.isNull(), "grade_points_not_numeric").when(~number.between(0, 10), "grade_points_out_of_range").when(F.abs(number - points(g)) > 0.5, "grade_points_mismatch"),
        F.when(~s.isin(*STATUSES), "invalid_status").when(m.isNotNull() & s.isin("PASS", "FAIL") & (s != derived), "status_inconsistency"),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def repaired_fields(marks: Column, maximum: Column, grade: Column, gp: Column, status: Column, pass_marks: Column | None = None) -> dict[str, Column]:
    """Marks clamped, then grade, points and status derived from them where they are missing or don't fit, in that order.

    A status that marks contradict is overwritten, ABSENT and WITHHELD too. ``fixed`` says whether anything changed.
    """
    m, top = whole(marks), F.coalesce(F.nullif(whole(maximum), F.lit(0)), F.lit(100))
    clamped = F.when(m.isNotNull(), F.least(F.greatest(m, F.lit(0)), top))
    g = F.upper(F.trim(F.coalesce(grade, F.lit(""))))
    good = (g != "") & points(g).isNotNull()
    new_grade = F.when(good, grade).when(clamped.isNotNull(), grade_of_marks(clamped, top)).otherwise(F.lit(""))
    number = F.trim(gp.cast("string")).try_cast("double")
    expected = points(new_grade)
    fits = number.between(0, 10) & (F.abs(number - expected) <= 0.5)
    new_points = F.when(expected.isNull() | F.coalesce(fits, F.lit(False)), number).otherwise(expected)
    new_status = F.when(clamped.isNotNull(), F.when(clamped >= _least_pass(top, pass_marks), "PASS").otherwise("FAIL")).otherwise(status)
    changed = ~clamped.eqNullSafe(marks.try_cast("double")) & m.isNotNull() | ~F.coalesce(new_grade == grade, grade.isNull() & (new_grade == "")) | ~new_points.eqNullSafe(number) | ~F.upper(new_status).eqNullSafe(F.upper(status))
    return {"total_marks": clamped, "grade": new_grade, "grade_points": new_points, "status": new_status, "fixed": changed}


def repaired(rows: DataFrame) -> DataFrame:
    """Subject rows repaired by ``repaired_fields``."""
    c = F.col
    fixed = repaired_fields(c("total_marks"), c("max_marks"), c("grade"), c("grade_points"), c("status"), c("pass_marks") if "pass_marks" in rows.columns else None)
    return rows.withColumns({k: v for k, v in fixed.items() if k != "fixed"})


def corrected_usn(usn: Column) -> Column:
    """A student number as scans get it wrong, put right: the letter O read for 0, a small l for 1 (where it is still small), blanks."""
    return F.replace(F.translate(F.upper(F.trim(usn)), "O", "0"), F.lit(" "), F.lit(""))


def guard_problems(record: Column) -> Column:
    """What keeps a record (sgpa, confidence, subjects of total_marks, grade_points) from being taken at all, as messages."""
    subjects = F.transform(
        record["subjects"],
        lambda s: F.filter(F.array(F.when(s["total_marks"].isNull(), "marks missing").when(s["total_marks"] < 0, "marks negative"), F.when(~s["grade_points"].between(0, 10), "points out of range")), lambda p: p.isNotNull()),
    )
    own = F.array(F.when(~record["sgpa"].between(0, 10), "sgpa out of range"), F.when(~record["confidence"].between(0, 1), "confidence out of range"))
    return F.concat(F.filter(own, lambda p: p.isNotNull()), F.coalesce(F.flatten(subjects), F.array().cast("array<string>")))


def sgpa_of(subjects: Column) -> Column:
    """Points by credits of an array of subjects (grade_points, credits): 0 points count, missing points don't; 3 credits if none.

    Points count in hundredths, so that the quotient is rounded in whole numbers.
    """
    known = F.filter(subjects, lambda s: s["grade_points"].isNotNull())
    credit = lambda s: F.when(s["credits"] > 0, s["credits"]).otherwise(3)
    weighted = F.aggregate(known, F.lit(0).cast("long"), lambda a, s: a + F.round(s["grade_points"] * 100).cast("long") * credit(s))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, s: a + credit(s))
    return gpa.ratio(weighted, total * 100, 2)


def validated(records: DataFrame) -> DataFrame:
    """Records with repaired subjects and averages, ``errors``, ``warnings``, ``valid`` and ``fixed``.

    A record has usn, semester, sgpa, cgpa and subjects (code, total_marks, max_marks, grade, grade_points, credits,
    status). Errors are what stays wrong with its subjects after repair; everything else is a warning.
    """
    kind = records.schema["subjects"].dataType.elementType.fieldNames()
    given = F.coalesce("subjects", F.array().cast(records.schema["subjects"].dataType))

    def fix(s: Column) -> Column:
        new = repaired_fields(s["total_marks"], s["max_marks"], s["grade"], s["grade_points"], s["status"], s["pass_marks"] if "pass_marks" in kind else None)
        return F.struct(*(new[k].alias(k) if k in new else s[k].alias(k) for k in kind), new["fixed"].alias("fixed"))

    rows = records.withColumn("subjects", F.transform(given, fix))
    problems = F.flatten(F.transform("subjects", lambda s, i: F.transform(subject_problems(s["total_marks"], s["max_marks"], s["grade"], s["grade_points"], s["status"], s["pass_marks"] if "pass_marks" in kind else None), lambda p: F.concat(F.lit("subject["), i.cast("string"), F.lit("]:"), p))))
    codes = F.transform("subjects", lambda s: F.upper(F.trim(F.coalesce(s["code"], F.lit("")))))
    again = F.filter(F.transform(codes, lambda c, i: F.when((c != "") & (F.array_position(codes, c) < i + 1), F.concat(F.lit("duplicate_subject_code:"), c))), lambda x: x.isNotNull())
    own = sgpa_of(F.col("subjects"))
    said = F.trim(F.col("sgpa").cast("string")).try_cast("double")
    mean = F.trim(F.col("cgpa").cast("string")).try_cast("double")
    far = own.isNotNull() & said.between(0, 10) & (F.abs(said - own) > 0.5)
    new_sgpa = F.when(own.isNotNull() & (said.isNull() | ~said.between(0, 10) | far), own).otherwise(clamp(said, 0.0, 10.0))
    sem = F.coalesce(F.nullif(whole(F.col("semester")), F.lit(0)), F.lit(1))
    bad = lambda c, v, n: F.when(v.isNull() & F.col(c).isNotNull(), f"{n}_not_numeric").when(~v.between(0, 10), f"{n}_out_of_range")
    warnings = F.filter(
        F.concat(
            F.array(usn_problem(F.col("usn")), F.when(~sem.between(1, 8), "semester_out_of_range"), F.when(F.size("subjects") == 0, "no_subjects_found")),
            again,
            F.array(F.coalesce(bad("sgpa", said, "sgpa"), F.when(far, "sgpa_inconsistency")), bad("cgpa", mean, "cgpa")),
        ),
        lambda w: w.isNotNull(),
    )
    changed = F.exists("subjects", lambda s: s["fixed"]) | ~sem.between(1, 8) | ~new_sgpa.eqNullSafe(said) | ~clamp(mean, 0.0, 10.0).eqNullSafe(mean)
    out = rows.withColumns({"errors": problems, "warnings": warnings, "fixed": changed, "new_sgpa": new_sgpa})
    out = out.withColumns({"valid": F.size("errors") == 0, "sgpa": F.col("new_sgpa"), "cgpa": clamp(mean, 0.0, 10.0), "semester": clamp(sem, 1, 8).cast("int")})
    return out.withColumn("subjects", F.transform("subjects", lambda s: F.struct(*(s[k].alias(k) for k in kind)))).drop("new_sgpa")


def normal_subject(rows: DataFrame) -> DataFrame:
    """Table rows with total, grade, points and status repaired; rows without marks and grade go.

    A number in place of a grade is taken as grade points. The scale knows NE and W, worth nothing.
    """
    total = F.coalesce(F.col("total"), F.col("internal") + F.col("external"))
    total = F.when(total.isNotNull(), F.greatest(F.least(total, F.col("max_marks")), F.lit(0)))  # least() passes over nulls
    raw = F.upper(F.trim(F.coalesce("grade", F.lit(""))))
    number = F.when(raw.rlike(r"\d"), raw.try_cast("double"))
    grade = F.coalesce(F.when(points(raw, SCALE_10).isNotNull(), raw), F.when(number >= 0, grade_of_points(number)), F.when(total.isNotNull(), grade_of_marks(total, F.col("max_marks"))), F.lit(""))
    expected = points(grade, SCALE_10)
    gp = F.when(expected.isNull(), F.when(F.col("grade_points").between(0, 10), F.col("grade_points"))).when(F.abs(F.col("grade_points") - expected) <= 0.5, F.col("grade_points")).otherwise(expected)
    said = F.upper(F.coalesce("status", F.lit("")))
    status = F.when(total.isNotNull(), F.when(total >= F.floor(F.col("max_marks") * 0.4), "PASS").otherwise("FAIL")).when(said.isin(*STATUSES), said).otherwise("FAIL")
    out = rows.withColumns({"_total": total, "_grade": grade, "_points": gp, "_status": status}).filter("_total is not null or _grade <> ''")
    renamed = {"total": F.col("_total"), "grade": F.col("_grade"), "grade_points": F.col("_points"), "status": F.col("_status"), "credits": F.coalesce(F.nullif("credits", F.lit(0)), F.lit(3))}
    return out.withColumns(renamed).drop("_total", "_grade", "_points", "_status")


#: Repair passes over corrupted grade columns, each a name, a condition and new values; later ones see earlier ones.
def repair_passes() -> list[tuple[str, Column, dict[str, Column]]]:
    """The seven passes in order."""
    number = F.when(F.col("grade").rlike(r"^[0-9]+([.][0-9]+)?$"), F.col("grade").try_cast("double"))
    valid = F.col("grade").isin(*SCALE_8)
    percent = grade_of_marks(number, F.lit(100))
    return [
        ("valid_grade", valid, {"grade_points": points(F.col("grade"))}),
        ("points_as_grade", number.between(0, 10), {"status": F.when(number >= 4, "PASS").otherwise("FAIL"), "grade_points": number, "grade": grade_of_points(number)}),
        ("percent_as_grade", (number > 10) & (number <= 100), {"status": F.when(number >= 40, "PASS").otherwise("FAIL"), "grade_points": points(percent), "grade": percent}),
        ("impossible_grade", number > 100, {"grade": F.lit("F"), "grade_points": F.lit(0.0), "status": F.lit("FAIL")}),
        ("impossible_points", F.col("grade_points") > 10, {"grade_points": F.lit(None).cast("double")}),
        ("status_of_grade", valid & ~F.col("status").isin("ABSENT", "WITHHELD"), {"status": F.when(F.col("grade") == "F", "FAIL").otherwise(F.lit("PASS"))}),
        ("points_of_grade", valid & (F.col("grade_points").isNull() | ~F.col("grade_points").isin(*sorted(set(SCALE_8.values())))), {"grade_points": points(F.col("grade"))}),
    ]


def repair_grades(rows: DataFrame) -> DataFrame:
    """The rows after all passes, with a boolean column for each pass: whether it touched the row."""
    rows = rows.withColumn("grade_points", F.col("grade_points").cast("double"))
    for name, condition, values in repair_passes():
        rows = rows.withColumn(name, F.coalesce(condition, F.lit(False)))
        rows = rows.withColumns({c: F.when(F.col(name), v).otherwise(F.col(c)) for c, v in values.items()})
    return rows


def vote_usn(candidates: DataFrame, document: str) -> DataFrame:
    """The student number with the most weight in each document; the first seen wins ties. Columns usn, strategy, seq."""
    usn = F.upper(F.trim("usn"))
    weight = (strategy_weight(F.col("strategy")) * 100).cast("int")
    votes = candidates.filter(usn_problem(F.col("usn")).isNull()).groupBy(document, usn.alias("usn")).agg(F.sum(weight).alias("votes"), F.min("seq").alias("first"))
    return votes.groupBy(document).agg(F.max_by("usn", F.struct("votes", -F.col("first"))).alias("usn"), F.max("votes").alias("votes"))


def vote_semester(candidates: DataFrame, document: str) -> DataFrame:
    """The semester (1 to 8) that most of a document's records name; the first seen wins ties. Columns semester, seq."""
    votes = candidates.filter(F.col("semester").between(1, 8)).groupBy(document, "semester").agg(F.count("*").alias("votes"), F.min("seq").alias("first"))
    return votes.groupBy(document).agg(F.max_by("semester", F.struct("votes", -F.col("first"))).alias("semester"))


def merged_subjects(rows: DataFrame, document: str) -> DataFrame:
    """One row per document and subject, from rows in order of trust (columns weight, seq); a fail stays a fail.

    The key is the code, else twenty letters of the name. Marks are the first there are, unless a later row states
    another maximum than 100 where they had 100. The grade is the first valid one; points that don't fit it follow it.
    """
    code, name = F.upper(F.trim(F.coalesce("code", F.lit("")))), F.upper(F.trim(F.coalesce("name", F.lit(""))))
    rows = rows.withColumn("merge_key", F.when(code != "", code).when(name != "", F.substring(name, 1, 20)).otherwise(F.concat(F.lit("SUBJ_"), F.col("weight").cast("string"), F.lit("_"), F.col("seq").cast("string"))))
    item = F.struct("weight", "seq", "code", "name", F.col("marks").cast("int").alias("marks"), F.coalesce(F.nullif(F.col("max_marks").cast("int"), F.lit(0)), F.lit(100)).alias("max_marks"), "grade", F.col("grade_points").cast("double").alias("grade_points"), "credits", "status")
    groups = rows.groupBy(document, "merge_key").agg(F.sort_array(F.collect_list(item)).alias("items"))  # as many items as strategies told of the subject
    known = lambda g: points(F.coalesce(g, F.lit("")), SCALE_10)

    def merge(held: Column, s: Column) -> Column:
        take = s["marks"].isNotNull() & (held["marks"].isNull() | ((s["max_marks"] != 100) & (held["max_marks"] == 100)))
        grade = F.when(known(s["grade"]).isNotNull() & known(held["grade"]).isNull(), F.upper(F.trim(s["grade"]))).otherwise(held["grade"])
        expected = known(grade)
        gp = F.when(expected.isNotNull(), F.when(F.abs(held["grade_points"] - expected) <= 0.5, held["grade_points"]).otherwise(expected)).otherwise(F.coalesce(held["grade_points"], s["grade_points"]))
        return F.struct(
            F.when(take, s["marks"]).otherwise(held["marks"]).alias("marks"), F.when(take, s["max_marks"]).otherwise(held["max_marks"]).alias("max_marks"), grade.alias("grade"), gp.alias("grade_points"),
            F.when(F.upper(s["status"]) == "FAIL", F.lit("FAIL")).otherwise(held["status"]).alias("status"),
        )

    first = F.get("items", F.lit(0))
    start = F.struct(*(first[k].alias(k) for k in ("marks", "max_marks", "grade", "grade_points", "status")))
    merged = F.aggregate(F.slice("items", 2, 1 << 20), start, merge)
    return groups.select(document, first["code"].alias("code"), first["name"].alias("name"), F.coalesce(first["credits"], F.lit(3)).cast("int").alias("credits"), F.struct(first["weight"], first["seq"]).alias("place"), merged.alias("m")).select(document, "code", "name", "credits", "place", "m.*")


def _confidence() -> Column:
    return F.round(F.least(F.lit(0.97), F.avg("confidence") + 0.04 * (F.size(F.collect_set("strategy")) - 1)), 3)


def merged_confidence(confidences: DataFrame, document: str) -> DataFrame:
    """Mean confidence and a bonus for each further strategy, at most 0.97."""
    return confidences.groupBy(document).agg(_confidence().alias("confidence"))


def merged_by_votes(records: DataFrame, document: str) -> DataFrame:
    """One record per document from the records of several strategies.

    Columns: strategy, seq, usn, name, semester, sgpa, cgpa, confidence, subjects (code, name, marks, max_marks, grade,
    grade_points, credits, status). Number and semester are voted on, subjects merged in ascending order of trust, the
    average worked out from them (else the mean of those stated), the longest name taken. A model's records of several
    semesters are kept as they are. Documents without number and subjects give nothing.

    A document's records are gathered first: every vote starts from that one exchange, and none is dealt again.
    """
    told = F.struct("strategy", "seq", "usn", "name", "semester", "sgpa", "cgpa", "confidence", "subjects")
    trust = lambda p: -next((w for name, w in WEIGHTS.items() if name in p), OTHER_WEIGHT)
    several = lambda p: F.size(F.array_distinct(F.transform(F.filter("told", lambda r: (r["strategy"] == p) & r["semester"].between(1, 8)), lambda r: r["semester"]))) > 1
    chosen = F.when(F.col(document).isNotNull(), F.coalesce(*(F.when(several(p), p) for p in sorted(SEMESTERS_CONFIDENCE, key=lambda p: (trust(p), p)))))
    rows = records.groupBy(document).agg(F.collect_list(told).alias("told")).select(document, chosen.alias("chosen"), F.explode("told").alias("r")).select(document, "chosen", "r.*")
    confidence = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SEMESTERS_CONFIDENCE.items() for x in p)), F.col("strategy")), F.lit(0.85))
    shape = "array<struct<code:string,name:string,marks:int,max_marks:int,grade:string,grade_points:double,credits:int,status:string>>"
    each = rows.filter(F.col("strategy") == F.col("chosen")).select(
        document, "usn", "name", F.col("semester").cast("int").alias("semester"), F.col("sgpa").cast("double").alias("sgpa"), F.col("cgpa").cast("double").alias("cgpa"), F.col("subjects").cast(shape).alias("subjects"), F.round(confidence, 3).alias("confidence"), F.concat("strategy", F.lit("_multisem")).alias("strategy"),
    )
    rows = rows.filter("chosen is null").withColumn("weight", strategy_weight(F.col("strategy")))
    seen = lambda c: F.avg(F.when(F.col(c).between(0, 10), F.col(c)))
    facts = rows.groupBy(document).agg(
        F.max_by(F.trim("name"), F.struct(F.length(F.trim("name")), -F.col("weight"), -F.col("seq"))).alias("name"), F.round(seen("sgpa"), 2).alias("said_sgpa"), F.round(seen("cgpa"), 2).alias("cgpa"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("seq", "strategy"))), lambda x: x["strategy"]), "+").alias("strategies"), _confidence().alias("confidence"),
    )
    long = rows.select(document, "weight", F.col("seq").alias("record"), F.posexplode("subjects").alias("at", "s")).select(document, "weight", (F.col("record") * 100000 + F.col("at")).alias("seq"), "s.*")
    subject = F.struct("place", "code", "name", "marks", "max_marks", "grade", "grade_points", "credits", "status")
    merged = merged_subjects(long, document).groupBy(document).agg(F.transform(F.sort_array(F.collect_list(subject)), lambda s: s.dropFields("place")).cast(shape).alias("subjects"))
    out = facts.join(merged, document, "left").join(vote_usn(rows, document), document, "left").join(vote_semester(rows, document), document, "left")
    subjects = F.coalesce("subjects", F.array().cast(shape))
    out = out.select(
        document, F.coalesce("usn", F.lit("UNKNOWN")).alias("usn"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("semester", F.lit(1)).cast("int").alias("semester"),
        F.coalesce(sgpa_of(subjects), "said_sgpa").alias("sgpa"), "cgpa", subjects.alias("subjects"), "confidence", F.array_join(F.array_distinct(F.split("strategies", r"\+")), "+").alias("strategy"),
    )
    return out.filter((F.col("usn") != "UNKNOWN") | (F.size("subjects") > 0)).unionByName(each)


def routed(records: DataFrame) -> DataFrame:
    """Records with where they go: stored, or queued for review."""
    return records.withColumn("route", F.when(F.col("confidence") < REVIEW_BELOW, "review").otherwise("store"))


def review_list(queue: DataFrame, status: str = "pending", limit: int = 50) -> DataFrame:
    """The newest items of a status."""
    return queue.filter(F.col("status") == status).orderBy(F.desc("created_at"), "id").limit(limit)


def reviewed(queue: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The queue after decisions (id, decision approve or reject, corrected_data, notes), one for each item at most.

    Approval with corrected data makes an item corrected, without it approved; rejection keeps its data.
    """
    d = decisions.select("id", "decision", F.col("corrected_data").alias("new_data"), F.col("notes").alias("new_notes"))
    approve, decided = F.col("decision") == "approve", F.col("decision").isNotNull()
    status = F.when(approve, F.when(F.col("new_data").isNotNull(), "corrected").otherwise("approved")).when(decided, "rejected").otherwise(F.col("status"))
    out = queue.join(d, "id", "left").withColumns(
        {"status": status, "corrected_data": F.when(approve, F.col("new_data")).otherwise(F.col("corrected_data")), "notes": F.when(decided, F.coalesce("new_notes", F.lit(""))).otherwise(F.col("notes")), "reviewed_at": F.when(decided, now).otherwise(F.col("reviewed_at"))}
    )
    return out.select(*queue.columns)


def run_score(steps: DataFrame, run: str) -> DataFrame:
    """Score of each run from its steps (tool, error) and goal: failures cost 0.2 each, up to 0.6; missing steps cost too."""
    ran = lambda tool: F.bool_or((F.col("tool") == tool) & F.col("error").isNull())
    rows = steps.groupBy(run).agg(F.count("tool").alias("n"), F.count("error").alias("failed"), ran("extract_records").alias("extracted"), ran("save_results").alias("saved"), F.lower(F.first("goal")).alias("goal"))
    about = F.col("goal").rlike("email|extract|process")
    score = 1.0 - F.least(F.col("failed") * 0.2, F.lit(0.6)) - F.when(about & ~F.coalesce("extracted", F.lit(False)), 0.15).otherwise(0.0) - F.when(about & F.col("goal").contains("save") & ~F.coalesce("saved", F.lit(False)), 0.10).otherwise(0.0)
    score = F.round(clamp(F.when(F.col("n") == 0, 0.0).otherwise(score), 0.0, 1.0), 3)
    return rows.select(run, "n", "failed", score.alias("score"), (score >= 0.5).alias("passed"))
