"""Functions that SQL statements can call, and tools by name.

``register`` makes them known to a session: grades and averages as SQL functions, which the planner inlines, and extraction steps
as table functions, to be joined with LATERAL. ``TOOLS`` names whole questions with their parameters, for callers that only know
a name and arguments; a tool answers with a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gradelake.functions.grades import LADDER, SCALE_8
from gradelake.functions.text import USN
from gradelake.operators import dedup, extract, gpa, mail, profile
from gradelake.plans.academic import Academic
from gradelake.plans.intents import guarded
from gradelake.sources.mailbox import MESSAGES, parsed

_LADDER = " ".join(f"WHEN 100.0 * marks / maximum >= {least} THEN '{grade}'" for least, grade in LADDER)
_POINTS = " ".join(f"WHEN '{grade}' THEN {least}" for grade, least in SCALE_8.items())
_REACHED = " ".join(f"WHEN points >= {least} THEN '{grade}'" for grade, least in SCALE_8.items())
_CREDITED = "aggregate(zip_with(points, credits, (p, c) -> p * c), 0D, (a, x) -> a + x)"
_CREDITS = "aggregate(credits, 0, (a, x) -> a + x)"

_USN = rf"(?i)\b({USN})\b".replace("\\", "\\\\")

#: Name and parameters, what it returns, its text.
SQL_FUNCTIONS = {
    "grade_of_marks(marks DOUBLE, maximum DOUBLE)": ("STRING", f"CASE WHEN maximum <= 0 THEN 'F' {_LADDER} ELSE 'F' END"),
    "points_of_grade(grade STRING)": ("DOUBLE", f"CASE upper(trim(grade)) {_POINTS} END"),
    "grade_of_points(points DOUBLE)": ("STRING", f"CASE WHEN points IS NULL THEN NULL {_REACHED} ELSE 'F' END"),
    "gpa_of(points ARRAY<DOUBLE>, credits ARRAY<INT>)": ("DOUBLE", f"CASE WHEN {_CREDITS} > 0 THEN floor((200 * {_CREDITED} + {_CREDITS}) / (2 * {_CREDITS})) / 100 END"),
    "usn_in(said STRING)": ("STRING", f"nullif(upper(regexp_extract(said, '{_USN}', 1)), '')"),
}


@udtf(returnType=MESSAGES.replace("\n", " "))
class MessageRows:
    """A raw message as its row: headers, body, attachments, what is wrong with it."""

    def eval(self, raw: bytes | str | None) -> Iterator[tuple]:
        """One row; none for null."""
        if raw is not None:
            yield parsed("", 0, raw.encode() if isinstance(raw, str) else bytes(raw))


@udtf(returnType="line int, cells array<string>, confidence double")
class BarRows:
    """The rows of a table written with bars, each with the confidence that its last cell states."""

    def eval(self, said: str | None) -> Iterator[tuple]:
        """A row for each line with two cells or more; lines that begin with # are left out, the first row is the header."""
        header = True
        for n, line in enumerate((said or "").split("\n")):
            cells = [c.strip() for c in line.strip().split("|")]
            if line.strip().startswith("#") or len(cells) < 2 or not any(cells):
                continue
            try:
                last = float(cells[-1])
            except ValueError:
                last = -1.0
            stated = 0 <= last <= 1
            yield n, cells[:-1] if stated else cells, last if stated and not header else 1.0
            header = False


TABLE_FUNCTIONS = {"message_rows": MessageRows, "bar_rows": BarRows}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; gives their names."""
    for head, (kind, text) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {text}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return sorted([head.split("(")[0] for head in SQL_FUNCTIONS] + list(TABLE_FUNCTIONS))


@dataclass(frozen=True)
class Tool:
    """A question by name: what it is for, its parameters' types, how it is answered."""

    name: str
    description: str
    category: str
    parameters: dict[str, str]
    answer: Callable[..., DataFrame]
    enabled: bool = True
    optional: dict[str, object] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(name: str, description: str, category: str, parameters: dict[str, str], /, **optional: object):
    """Register a function of (data, ...parameters) as a tool; ``optional`` gives parameters' defaults."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS[name] = Tool(name, description, category, parameters, function, optional=optional)
        return function

    return add


_TYPES = {"str": str, "int": int, "float": (int, float), "table": DataFrame}


def call(name: str, data: Academic, /, **arguments: object) -> DataFrame:
    """The answer of a tool; ValueError for a name, parameter or type that isn't known, RuntimeError if it is switched off."""
    found = TOOLS.get(name)
    if found is None:
        raise ValueError(f"no such tool: {name}; there are {', '.join(sorted(TOOLS))}")
    if not found.enabled:
        raise RuntimeError(f"{name} is switched off")
    given = found.optional | arguments
    if wrong := set(given) ^ set(found.parameters):
        raise ValueError(f"{name} takes {', '.join(found.parameters)}; wrong or missing: {', '.join(sorted(wrong))}")
    for key, kind in found.parameters.items():
        if given[key] is not None and not isinstance(given[key], _TYPES[kind]):
            raise ValueError(f"{name}: {key} must be {kind}")
    return found.answer(data, **given)


def listed(spark: SparkSession) -> DataFrame:
    """name, description, category, parameters of the tools that are switched on."""
    rows = [(t.name, t.description, t.category, t.parameters) for t in TOOLS.values() if t.enabled]
    return spark.createDataFrame(rows, "name string, description string, category string, parameters map<string,string>")


@tool("student_lookup", "Students by number or part of their name", "query", {"usn": "str", "name": "str"}, usn=None, name=None)
def _student_lookup(data: Academic, usn: str | None, name: str | None) -> DataFrame:
    rows = data.students if usn is None else data.students.filter(F.upper("usn") == usn.upper())
    return rows if name is None else rows.filter(F.upper("name").contains(name.upper()))


@tool("gpa_compute", "A student's averages by semester and over all", "compute", {"usn": "str"})
def _gpa_compute(data: Academic, usn: str) -> DataFrame:
    who = data.students.filter(F.upper("usn") == usn.upper()).select("student_id")
    semesters = gpa.sgpa_standard(data.results.join(who, "student_id", "left_semi"), data.subjects)
    every = gpa.cgpa_standard(semesters).select(F.lit(None).cast("int").alias("semester"), F.col("cgpa").alias("average"))
    return semesters.select("semester", F.col("sgpa").alias("average")).unionByName(every)


@tool("backlogs", "Students with open subjects, most first", "query", {"limit": "int"}, limit=50)
def _backlogs(data: Academic, limit: int | None) -> DataFrame:
    return profile.backlog_list(data.students, data.results, limit)


@tool("top_students", "The best students by an average", "query", {"limit": "int", "metric": "str"}, limit=10, metric="cgpa")
def _top_students(data: Academic, limit: int, metric: str) -> DataFrame:
    return profile.top_by(profile.visible(data.students), data.results, data.subjects, metric, limit)


@tool("query_db", "One read-only statement over students, subjects and results", "query", {"sql": "str"})
def _query_db(data: Academic, sql: str) -> DataFrame:
    return guarded(data.students.sparkSession, sql, students=data.students, subjects=data.subjects, results=data.results)


@tool("extract_records", "Student records in mails (mail_id, subject, body)", "extraction", {"mails": "table"})
def _extract_records(data: Academic, mails: DataFrame) -> DataFrame:
    return extract.extract_records(mails)


@tool("classify_email", "Result mails and others, by keywords of subject and body", "classification", {"mails": "table"})
def _classify_email(data: Academic, mails: DataFrame) -> DataFrame:
    return mail.by_keywords(mails, "subject", "body")


@tool("dedup_check", "Messages (message_key) that aren't among those seen (message_key)", "ingestion", {"messages": "table", "seen": "table"})
def _dedup_check(data: Academic, messages: DataFrame, seen: DataFrame) -> DataFrame:
    return dedup.unseen(messages, seen, F.col("message_key"))
