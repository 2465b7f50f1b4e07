"""Result records from free text, tables and sheets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.grades import points, to_double
from gradelake.functions.text import ROMAN, USN, USN_LABEL, semester, stripped
from gradelake.operators.quality import normal_subject

#: Letters that stand for a fail, in lists and after marks.
FAIL_LETTERS = ("F", "E", "U", "AB", "W")
FAIL_AFTER_MARKS = ("F", "AB", "W", "X")
_SUBJECT = "struct<code:string,name:string,marks:int,max_marks:int,grade:string,status:string>"


@dataclass(frozen=True)
class LineFormat:
    """A way in which a line states a subject's result: a pattern, and the group number of each field."""

    name: str
    pattern: str
    fields: dict[str, int]
    trim: str = ""
    fails: tuple[str, ...] = ()
    skip: tuple[str, ...] = field(default=())


#: Line formats in the order in which they are tried; a later one counts only where no earlier one found a subject.
FORMATS = (
    LineFormat("A", r"(?im)^([A-Z0-9]{4,12})\s*[-–:]\s*([^:\n]{3,60}?)[:\s]+(\d{1,3})(?:[/ ](\d{1,3}))?\s*(?:marks?)?\s*[-–]?\s*(PASS|FAIL|P|F)\b", {"code": 1, "name": 2, "marks": 3, "max": 4, "status": 5}, " -–:"),
    LineFormat("D", r"(?i)([A-Z0-9]{4,10})\s*\|\s*([^|\n]{3,50}?)\s*\|[^|]*\|[^|]*\|\s*(\d{1,3})\s*\|\s*(\d{1,3})\s*\|\s*([A-Za-z][+\-]?)\s*\|\s*(PASS|FAIL|P|F)", {"code": 1, "name": 2, "marks": 3, "max": 4, "grade": 5, "status": 6}),
    LineFormat("E", r"(?im)([A-Za-z][\w\s&/()'\-]{2,50}?)\s*\|\s*(\d{1,3})\s*(?:\|[^|]*)?\|\s*(PASS|FAIL|P|F)", {"name": 1, "marks": 2, "status": 3}, " -–*•|", skip=("subject", "paper", "course", "name")),
    LineFormat("B", r"(?i)(?:[-•*]\s*)([^:|\n]{3,50}):\s*(\d{1,3})(?:/(\d{1,3}))?\s*[-–]?\s*(PASS|FAIL)", {"name": 1, "marks": 2, "max": 3, "status": 4}, " -–*•"),
    LineFormat("C", r"(?i)Subject[:\s]+([\w\s&-]+?)\s*\|.*?Marks[:\s]+(\d{1,3}).*?Status[:\s]+(PASS|FAIL)", {"name": 1, "marks": 2, "status": 3}),
    LineFormat("F", r"(?m)^[A-Za-z0-9_\-]+\s*,\s*([A-Za-z][A-Za-z0-9\s&/()'\-]{1,50}?)\s*,\s*(\d{1,3})\s*,\s*([A-Za-z][+\-]?)\s*$", {"name": 1, "marks": 2, "grade": 3}, fails=FAIL_LETTERS),
    LineFormat("G", r"(?m)^(.{3,60}?)\s*[–\-]\s*(\d{1,3})\s*[–\-]\s*Grade\s+([A-Za-z][+\-]?)\s*$", {"name": 1, "marks": 2, "grade": 3}, " -–", FAIL_AFTER_MARKS),
)
#: What a text must hold for a format to find anything: plain strings that its pattern can't do without.
NEEDED = {"A": (), "D": ("|",), "E": ("|",), "B": (":",), "C": ("|",), "F": (",",), "G": ("Grade",)}
#: Averages, names, and blocks of several semesters.
_SGPA = r"(?i)(?:s\.?g\.?p\.?a|semester\s+gpa|grade\s+point)[^\d]*(\d{1,2}\.\d{1,2})"
_CGPA = r"(?i)(?:c\.?g\.?p\.?a|cumulative\s+gpa|overall\s+gpa)[^\d]*(\d{1,2}\.\d{1,2})"
_NAME = r"(?i)(?:student\s*(?:name)?|name|dear)\s*[:\s,]+([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,4})"
_BLOCK = r"(?is)Semester\s+(\d{1,2})(?:\s+Results?)?\b[^\n]*\n(.*?)(?=\n[-—]{3,}|\nSemester\s+\d|\z)"
_BLOCK_SGPA = r"(?i)SGPA\s*:\s*(\d{1,2}\.\d{1,2})"
_RAW_SUBJECT = r"(?i)\b([A-Z]{2,4}\d{2,4})\b[^\n]*?(\d{2,3})\s*/?\s*(\d{2,3})?\s+([A-F][+-]?)\s+(PASS|FAIL)"
_CUT = "\x01"


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def _trimmed(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}\\s]+|[{chars}\\s]+$".replace("-", r"\-"), "") if chars else stripped(text)


def subjects_in(text: Column, f: LineFormat) -> Column:
    """The subjects that a text states in a format, as an array of structs, in order.

    Each matched line is taken apart by one replacement that puts a mark between its groups.
    """
    lines = F.regexp_extract_all(text, F.lit(f.pattern), F.lit(0))
    n = max(f.fields.values())
    marked = lambda line: F.split(F.regexp_replace(line, f.pattern, _CUT.join(f"${k}" for k in range(1, n + 1))), _CUT)

    def subject(groups: Column) -> Column:
        get = lambda k: F.nullif(F.get(groups, F.lit(f.fields[k] - 1)), F.lit("")) if k in f.fields else F.lit(None).cast("string")
        grade = F.upper(stripped(F.coalesce(get("grade"), F.lit(""))))
        said = F.upper(get("status"))
        status = F.when(said.startswith("P"), "PASS").otherwise("FAIL") if "status" in f.fields else F.when(grade.isin(*f.fails), "FAIL").otherwise("PASS")
        return F.struct(
            F.upper(stripped(F.coalesce(get("code"), F.lit("")))).alias("code"), _trimmed(F.coalesce(get("name"), F.lit("")), f.trim).alias("name"), get("marks").try_cast("int").alias("marks"),
            F.coalesce(get("max").try_cast("int"), F.lit(100)).alias("max_marks"), grade.alias("grade"), status.alias("status"),
        ).cast(_SUBJECT)

    def counts(s: Column) -> Column:
        ok = s["marks"].between(0, 200)
        if "code" in f.fields:
            ok &= ~s["code"].rlike(rf"^{USN}\b")
        if f.name == "A":
            ok &= s["code"].rlike(r"\d")
        return ok & ~F.lower(s["name"]).isin(*f.skip) if f.skip else ok

    return F.filter(F.transform(F.transform(lines, marked), subject), counts)


def first_of_each(subjects: Column) -> Column:
    """Subjects without later ones of the same code (or name where there is no code); nameless ones go."""
    keys = F.transform(subjects, lambda s: F.upper(stripped(F.coalesce(F.nullif(s["code"], F.lit("")), s["name"]))))
    return F.filter(subjects, lambda s, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))


def usns_in(text: Column) -> Column:
    """The student numbers of a text, those after a label first."""
    found = F.concat(F.regexp_extract_all(text, F.lit(USN_LABEL), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"(?i)\b({USN})\b"), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda u: F.upper(u)))


def extract_records(mails: DataFrame, key: str = "mail_id", subject: str = "subject", body: str = "body") -> DataFrame:
    """One row per mail, student and semester: usn, name, semester, sgpa, cgpa, subjects, confidence, strategy.

    Formats are tried in order, each only where the earlier ones found nothing. A mail in which a semester's block lists
    subjects by grade gives a record for each such block instead. A mail without a student number gives nothing.
    Column expressions throughout: no shuffle.
    """
    text = F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    rows = mails.select(key, text.alias("text")).withColumn("usns", usns_in(F.col("text"))).filter("size(usns) > 0")
    name = stripped(F.regexp_replace(F.regexp_extract("text", _NAME, 1), r"(?i)\s+(USN|No|Number|ID|Code|Register|Student)\s*$", ""))
    name = F.when(F.replace(name, F.lit(" "), F.lit("")).rlike(rf"(?i)^{USN}\b"), "").otherwise(name)
    rows = rows.withColumns({"name": name, "semester": semester(F.col("text")), "sgpa": _number(F.col("text"), _SGPA), "cgpa": _number(F.col("text"), _CGPA)})
    blocks = F.transform(F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(0)), lambda b: F.struct(F.regexp_extract(b, r"(?i)^Semester\s+(\d{1,2})", 1).cast("int").alias("semester"), F.regexp_replace(b, r"^[^\n]*\n", "").alias("text")))
    grades = FORMATS[-1]
    told = F.transform(blocks, lambda b: F.struct(b["semester"].alias("semester"), _number(b["text"], _BLOCK_SGPA).alias("sgpa"), subjects_in(b["text"], grades).alias("subjects")))
    # A cheap look decides whether a pattern can find anything at all.
    may = {f.name: reduce(Column.__and__, (F.col("text").contains(x) for x in NEEDED[f.name]), F.lit(True)) for f in FORMATS}
    rows = rows.withColumn("blocks", F.when(may[grades.name], F.filter(told, lambda b: F.size(b["subjects"]) > 0)).otherwise(F.array().cast(f"array<struct<semester: int, sgpa: double, subjects: array<{_SUBJECT}>>>")))
    none = F.array().cast(f"array<{_SUBJECT}>")
    found = F.when(F.size("blocks") > 0, none).otherwise(none)
    for f in FORMATS:  # a step for each format: the next one's pattern runs only where this one's array is empty
        rows = rows.withColumn(f"found_{f.name}", F.when((F.size("blocks") == 0) & (F.size(found) == 0) & may[f.name], subjects_in(F.col("text"), f)).otherwise(found))
        found = F.col(f"found_{f.name}")
    whole = F.array(F.struct(F.col("semester"), F.col("sgpa"), first_of_each(found).alias("subjects"), F.lit(0.80).alias("confidence"), F.lit("text_regex").alias("strategy")))
    each = F.transform("blocks", lambda b: F.struct(b["semester"].alias("semester"), b["sgpa"].alias("sgpa"), b["subjects"].alias("subjects"), F.lit(0.90).alias("confidence"), F.lit("text_regex_vtu_multisem").alias("strategy")))
    out = rows.select(key, "usns", "name", "cgpa", F.explode(F.when(F.size("blocks") > 0, each).otherwise(whole)).alias("r"))
    return out.select(key, F.explode("usns").alias("usn"), "name", "r.semester", "r.sgpa", "cgpa", "r.subjects", "r.confidence", "r.strategy")


def subject_rows(records: DataFrame, *keys: str) -> DataFrame:
    """One row per subject of each record."""
    return records.select(*keys, F.explode("subjects").alias("s")).select(*keys, "s.*")


def extract_results(mails: DataFrame, key: str = "mail_id", subject: str = "subject", body: str = "body") -> DataFrame:
    """One row per student, mail and subject."""
    return subject_rows(extract_records(mails, key, subject, body), key, "usn", "semester")


def raw_text_records(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Records of free text cut at each student number: a row for each subject line, else one with the averages."""
    blocks = texts.select(key, F.posexplode(F.split(F.col(text), rf"(?i)(?=\b{USN}\b)")).alias("at", "block"))
    usn = F.upper(F.regexp_extract("block", rf"(?i)\b({USN})\b", 1))
    post = stripped(F.regexp_replace("block", rf"(?is)^.*?\b{USN}\b", ""))
    name = F.regexp_extract(post, r"^([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3})", 1)
    rows = blocks.withColumn("usn", usn).filter("usn <> ''")
    sem = F.coalesce(F.regexp_extract("block", r"(?i)semester[:\s]+(\d)", 1).try_cast("int"), F.lit(1))
    gpa = r"(?i)(?:s\.?g\.?p\.?a|semester\s+gpa)[^\d]*(\d{1,2}\.\d{1,2})"
    rows = rows.withColumns({"name": F.coalesce(F.nullif(name, F.lit("")), F.col("usn")), "semester": sem, "sgpa": _number(F.col("block"), gpa), "cgpa": _number(F.col("block"), _CGPA)})
    marked = lambda line: F.split(F.regexp_replace(line, _RAW_SUBJECT, _CUT.join(f"${k}" for k in range(1, 6))), _CUT)
    lines = F.transform(F.regexp_extract_all("block", F.lit(_RAW_SUBJECT), F.lit(0)), marked)
    rows = rows.select(key, "at", "usn", "name", "semester", "sgpa", "cgpa", F.explode_outer(lines).alias("g"))
    got = lambda k: F.nullif(F.get("g", F.lit(k)), F.lit(""))
    bare = F.col("g").isNull()
    return rows.select(
        key, "at", "usn", "name", "semester", F.when(bare, F.col("sgpa")).alias("sgpa"), F.when(bare, F.col("cgpa")).alias("cgpa"), F.upper(got(0)).alias("code"), got(1).try_cast("double").alias("marks"),
        F.when(~bare, F.coalesce(got(2).try_cast("double"), F.lit(100.0))).alias("max_marks"), F.upper(got(3)).alias("grade"), F.upper(got(4)).alias("status"),
    )


#: The field that a header cell names, by the first line below of which it holds a word.
HEADERS = (
    (("usn", "register", "reg no", "roll no"), "usn"),
    (("student name", "name"), "name"),
    (("sub code", "subject code", "course code", "code"), "subject_code"),
    (("subject name", "subject", "course", "paper"), "subject_name"),
    (("credits", "credit"), "credits"),
    (("internal", "cie", "ia", "int"), "internal_marks"),
    (("external", "see", "ext", "theory"), "external_marks"),
    (("total marks", "total", "marks obtained", "scored"), "total_marks"),
    (("max marks", "maximum", "out of"), "max_marks"),
    (("grade pts", "grade point", "gp"), "grade_points"),
    (("grade",), "grade"),
    (("status", "result"), "status"),
    (("sgpa",), "sgpa"),
    (("cgpa",), "cgpa"),
    (("sem", "semester"), "semester"),
)
FIELDS = tuple(name for _, name in HEADERS)


def header_field(cell: Column) -> Column:
    """The field that a header cell names; null if none."""
    return _named(F.lower(stripped(cell)))


def _named(low: Column) -> Column:
    """The field that a stripped cell in lower case names."""
    out = F.when(F.lit(False), F.lit(""))
    for words, name in HEADERS:
        out = out.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(name))
    return out


def table_rows(cells: DataFrame, document: str, table: str, row: str) -> DataFrame:
    """Subject rows of raw tables (one row of ``cells`` each): a column for each field of the table's header.

    The header is the first of ten rows in which three cells name fields. A student's number and name are carried down
    to the rows that lack them. Rows without a subject, or with neither marks nor grade, are left out.

    A cell is stripped once, and only the first ten rows are looked at for a header: a header brings each field's place.
    """
    of = Window.partitionBy(document, table)
    first = F.col(row) < 10
    rows = cells.select(document, table, row, F.transform("cells", stripped).alias("cells"))
    # Steps of their own: a value that is used in each branch of a choice would be made again for each.
    low = rows.withColumn("low", F.when(first, F.transform("cells", F.lower)))
    rows = low.withColumn("named", F.when(first, F.transform("low", _named))).drop("low")
    is_header = first & (F.size(F.filter("named", lambda n: n.isNotNull())) >= 3)
    last = F.reverse("named")  # the last column of a name counts
    places = F.array(*(F.when(F.array_contains("named", n), (F.size("named") - F.array_position(last, n)).cast("int")) for n in FIELDS))
    rows = rows.withColumn("header", F.min(F.when(is_header, F.struct(F.col(row).alias("row"), places.alias("at")))).over(of))
    rows = rows.filter(F.col("header").isNotNull() & (F.col(row) > F.col("header.row")) & F.exists("cells", lambda c: c != ""))

    def cell(k: int) -> Column:
        at = F.get("header.at", F.lit(k))
        return F.when(at.isNotNull(), F.coalesce(F.get("cells", at), F.lit("")))

    rows = rows.select(document, table, row, *(cell(k).alias(n) for k, n in enumerate(FIELDS)))
    new = F.col("usn").rlike(rf"(?i)^{USN}\b")
    above = of.orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"usn": F.coalesce(F.last(F.when(new, F.upper("usn")), True).over(above), F.col("usn")), "name": F.coalesce(F.last(F.when(new, F.col("name")), True).over(above), F.col("name"))})
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return rows.filter(~(blank("subject_code") & blank("subject_name")) & ~(blank("total_marks") & blank("grade")))


def table_records(rows: DataFrame, document: str) -> DataFrame:
    """Records of subject rows (``table_rows``): one per document, student and semester, subjects normalised."""
    number = lambda c: F.trim(F.col(c)).try_cast("double").try_cast("int")
    typed = rows.select(
        document, F.upper(F.trim(F.coalesce(F.nullif("usn", F.lit("")), F.lit("UNKNOWN")))).alias("usn"), F.least(F.greatest(F.coalesce(number("semester"), F.lit(1)), F.lit(1)), F.lit(8)).alias("semester"),
        F.upper(F.trim(F.coalesce("subject_code", F.lit("")))).alias("code"), F.trim(F.coalesce("subject_name", F.lit(""))).alias("name"), number("internal_marks").alias("internal"), number("external_marks").alias("external"),
        number("total_marks").alias("total"), F.coalesce(F.nullif(number("max_marks"), F.lit(0)), F.lit(100)).alias("max_marks"), F.col("grade"), F.trim("grade_points").try_cast("double").alias("grade_points"),
        number("credits").alias("credits"), F.col("status"),
    )
    subject = F.struct("code", "name", "internal", "external", "total", "max_marks", "grade", "grade_points", "credits", "status")
    out = normal_subject(typed).groupBy(document, "usn", "semester").agg(F.sort_array(F.collect_list(subject)).alias("subjects"))
    return out.withColumns({"confidence": F.lit(0.80), "strategy": F.lit("document_parser")})


#: Fixed value: words that show a header cell.
HEADER_WORD = r"(?i)\b(subject|code|name|usn|marks|grade|status|result|total|max|pass|fail|serial|no\.?|s\.no|sl\.?|semester|sem|sgpa|cgpa|credits?)\b"


def stitch_tables(cells: DataFrame, document: str, table: str, row: str, percent: int = 60) -> DataFrame:
    """``cells`` with pages of one table joined: document, table and row numbered anew, cells.

    Each page is known by its first row: whether a third of its cells hold header words, and its cells. A fold over a
    document's pages numbers the tables: a page goes on if it is about as wide as the table's header and has no header of
    its own, or one that is ``percent`` per cent the same, which is left out. Rows then follow by number; only first rows
    are gathered, one array a document.
    """
    nth = F.row_number().over(Window.partitionBy(document, table).orderBy(row))
    rows = cells.select(document, table, row, "cells").withColumn("nth", nth)
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    headed = F.size(F.filter(low, lambda c: c.rlike(HEADER_WORD))) >= F.greatest(F.lit(1), F.floor(F.size("cells") / 3))
    pages = rows.filter("nth = 1").groupBy(document).agg(F.sort_array(F.collect_list(F.struct(F.col(table).alias("page"), low.alias("first"), ((F.size("cells") > 0) & headed).alias("headed")))).alias("pages"))

    def placed(so_far: Column, page: Column) -> Column:
        head, first = so_far["head"], page["first"]
        same = F.size(F.filter(F.zip_with(head, first, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
        alike = same * 100 >= F.greatest(F.size(head), F.size(first), F.lit(1)) * percent
        goes_on = (so_far["n"] >= 0) & (F.abs(F.size(head) - F.size(first)) <= 1) & (~page["headed"] | alike)
        n = F.when(goes_on, so_far["n"]).otherwise(so_far["n"] + 1)
        own = F.struct(page["page"].alias("page"), n.alias("n"), (goes_on & page["headed"]).alias("bare"))
        return F.struct(n.alias("n"), F.when(goes_on, head).otherwise(first).alias("head"), F.concat(so_far["pages"], F.array(own)).alias("pages"))

    none = F.expr(f"cast(array() as array<struct<page: {cells.schema[table].dataType.simpleString()}, n: int, bare: boolean>>)")
    start = F.struct(F.lit(-1).alias("n"), F.expr("cast(array() as array<string>)").alias("head"), none.alias("pages"))
    numbered = pages.select(F.col(document).alias("of"), F.explode(F.aggregate("pages", start, placed)["pages"]).alias("p")).select("of", "p.*")
    joined = rows.join(numbered, F.col(document).eqNullSafe(F.col("of")) & (F.col(table) == F.col("page"))).filter("not (bare and nth = 1)")
    place = F.row_number().over(Window.partitionBy(document, "n").orderBy(table, row)) - 1
    return joined.select(document, F.col("n").alias(table), place.alias(row), "cells")


def row_maps(cells: DataFrame, *keys: str, row: str) -> DataFrame:
    """Rows of a table as maps from the first row's cells, in lower case, to values; short rows are filled with blanks."""
    of = Window.partitionBy(*keys).orderBy(row)
    rows = cells.withColumn("header", F.first("cells").over(of)).withColumn("nth", F.row_number().over(of)).filter("nth > 1")
    names = F.transform("header", lambda h: F.lower(stripped(h)))
    values = F.transform("header", lambda h, i: F.coalesce(stripped(F.get("cells", i)), F.lit("")))
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size("header")).alias("i")), lambda x: x["i"] == F.size("header") - F.array_position(F.reverse(names), x["k"]) + 1)
    made = F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))
    return rows.select(*keys, row, made.alias("fields")).filter(F.exists(F.map_values("fields"), lambda v: v != ""))


def piped_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a table written with bars: cells, and the confidence that a last cell between 0 and 1 states (else 1)."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "said")).withColumn("said", stripped(F.col("said")))
    rows = lines.filter("said <> '' and not startswith(said, '#')").select(key, "line", F.transform(F.split("said", r"\|"), stripped).alias("cells"))
    rows = rows.filter((F.size("cells") >= 2) & F.exists("cells", lambda c: c != ""))
    last = F.element_at("cells", -1).try_cast("double")
    scored = last.between(0, 1)
    header = F.row_number().over(Window.partitionBy(key).orderBy("line")) == 1
    out = rows.withColumns({"confidence": F.when(header | ~F.coalesce(scored, F.lit(False)), 1.0).otherwise(last), "scored": F.coalesce(scored, F.lit(False))})
    return out.select(key, "line", F.when(F.col("scored"), F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")).alias("cells"), "confidence")


def sheet_rows(sheet: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """A sheet of strings with its columns resolved by header aliases; numbers are read leniently."""
    have = {c.strip().lower(): c for c in sheet.columns}
    col = lambda k: next((F.col(f"`{have[a]}`") for a in aliases[k] if a in have), F.lit(None).cast("string"))
    out = {k: F.trim(col(k)) for k in aliases}
    usn = F.upper(F.regexp_extract(F.coalesce(out["usn"], F.lit("")), rf"(?i)({USN})", 1))
    good = F.upper(out["status"]).isin("PASS", "P", "1", "TRUE", "YES", "OK")
    return sheet.select(
        F.nullif(usn, F.lit("")).alias("usn"), out["name"].alias("name"), out["code"].alias("code"), to_double(out["marks"]).alias("marks"), to_double(out["sgpa"]).alias("sgpa"),
        F.when(out["status"].isNotNull(), F.when(good, "PASS").otherwise("FAIL")).alias("status"),
    ).filter("usn is not null")


def unpivot_grades(sheet: DataFrame, keys: list[str]) -> DataFrame:
    """A wide grade report as one row per student and subject; blank, NE and AB cells are left out."""
    subjects = [c for c in sheet.columns if c not in keys]
    rows = sheet.unpivot(keys, subjects, "code", "grade").withColumn("grade", F.upper(F.trim("grade")))
    rows = rows.filter(F.col("grade").isNotNull() & ~F.col("grade").isin("", "NAN", "NE", "AB"))
    return rows.withColumn("grade_points", points(F.col("grade"))).withColumn("status", F.when((F.col("grade") == "F") | (F.col("grade_points") == 0), "FAIL").otherwise("PASS"))


def grade_report(cells: DataFrame, document: str, row: str) -> DataFrame:
    """A wide grade report as cells, back to rows: document, usn, semester, code, name, grade, grade_points, status.

    The row with a USN cell (among the first 21) holds the subject codes, the next one their names; a row of GR and GP
    cells within eight rows says which columns are grades and which points. Students follow. A roman numeral in a
    column headed by the word semester is theirs.
    """
    of = Window.partitionBy(document)
    low = F.transform("cells", lambda c: F.lower(stripped(F.coalesce(c, F.lit("")))))
    rows = cells.select(document, row, "cells", low.alias("low"))
    rows = rows.withColumn("head", F.min(F.when((F.col(row) <= 20) & F.exists("low", lambda c: c.contains("usn")), F.col(row))).over(of))
    kinds = F.exists("low", lambda c: c == "gr") & (F.col(row) > F.col("head")) & (F.col(row) <= F.col("head") + 8)
    rows = rows.withColumn("kinds", F.min(F.when(kinds, F.col(row))).over(of))
    pick = lambda at, c: F.max(F.when(F.col(row) == at, F.col(c))).over(of)
    rows = rows.withColumns({"codes": pick(F.col("head"), "cells"), "heads": pick(F.col("head"), "low"), "names": pick(F.col("head") + 1, "cells"), "what": pick(F.col("kinds"), "low")})
    at = F.array_position(F.transform("heads", lambda c: c.contains("usn")), True)
    sem_at = F.array_position(F.transform("heads", lambda c: c.contains("sem")), True)
    roman = F.try_element_at(F.create_map(*(F.lit(x) for p in ROMAN.items() for x in p)), F.get("low", (sem_at - 1).cast("int")))
    body = rows.filter(F.col(row) > F.coalesce("kinds", F.col("head") + 1)).withColumns({"usn": F.upper(F.regexp_extract(F.get("cells", (at - 1).cast("int")), rf"(?i)({USN})", 1)), "semester": F.coalesce(roman, F.lit(1))}).filter("usn <> ''")
    long = body.select(document, "usn", "semester", "codes", "names", "what", "cells", F.posexplode("cells").alias("col", "cell")).filter(F.get("what", F.col("col")) == "gr")
    grade = F.upper(stripped(F.col("cell")))
    has_points = F.get("what", F.col("col") + 1) == "gp"
    gp = F.coalesce(F.when(has_points, F.get("cells", F.col("col") + 1).try_cast("double")), points(grade))
    long = long.select(document, "usn", "semester", F.upper(stripped(F.get("codes", F.col("col")))).alias("code"), stripped(F.coalesce(F.get("names", F.col("col")), F.lit(""))).alias("name"), grade.alias("grade"), gp.alias("grade_points"))
    long = long.filter(~F.col("grade").isin("NAN", "", "NE", "AB"))
    return long.withColumn("status", F.when((F.col("grade") == "F") | (F.coalesce("grade_points", F.lit(1.0)) == 0), "FAIL").otherwise("PASS"))


def carried_down(rows: DataFrame, document: str, order: str, *columns: str) -> DataFrame:
    """Blank cells of ``columns`` filled from the last row above that has one."""
    above = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(above) for c in columns})
