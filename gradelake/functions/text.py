"""Identifiers, names, HTML, dates and cells as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.grades import literal_map

#: The shapes of a student number, by who writes it.
USN = r"[1-4][A-Z]{2}[0-9]{2}[A-Z]{2,4}[0-9]{3}"
USN_SHAPES = {
    "any": USN,
    "planner": r"[1-4][A-Z]{2}[0-9]{2}[A-Z]{2,3}[0-9]{3}",
    "msrit": r"1MS[0-9]{2}CS[0-9]{3}",
    "autonomous": r"[A-Z]{2,4}[0-9]{2,4}[A-Z]{2,4}[0-9]{3,4}",
    "university": r"[A-Z0-9]{6,12}",
}
#: Fixed value: a student number after its label.
USN_LABEL = rf"(?i)(?:USN|Reg(?:istration)?\s*No\.?)[\s:]+({USN})\b"
#: Semester numbers by roman numeral and by ordinal.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
ORDINAL = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8}
#: Fixed value: what can stand for a semester after the word.
_SEMESTER_WORD = r"(?i)(?:semester|sem)[\s:]+(I{1,3}V?|VI{0,3}|IV|VIII?|IX?X?|first|second|third|fourth|fifth|sixth|seventh|eighth|\d{1,2}(?:st|nd|rd|th)?)"
#: Fixed value: subject codes that the text rewrite marks.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def batch_year(usn: Column) -> Column:
    """The year of admission within a student number."""
    return F.substring(usn, 4, 2).try_cast("int") + 2000


def department(usn: Column) -> Column:
    """The department letters within a student number."""
    return F.upper(F.substring(usn, 6, 2))


def usn_shapes(text: Column) -> Column:
    """The names of the shapes that a student number has as a whole."""
    found = F.array(*(F.when(F.upper(F.trim(text)).rlike(f"^{shape}$"), F.lit(name)) for name, shape in USN_SHAPES.items()))
    return F.filter(found, lambda n: n.isNotNull())


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normal_name(name: Column) -> Column:
    """Upper case with single spaces."""
    return F.regexp_replace(F.upper(F.trim(name)), r"\s+", " ")


def normal_text(text: Column) -> Column:
    """Lower case, everything but letters, digits and spaces folded to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def subject_code(name: Column) -> Column:
    """A code made from a subject's name: initials of up to three words and four digits of its hash."""
    upper = F.upper(F.trim(name))
    initials = F.array_join(F.transform(F.slice(F.split(upper, r"\s+"), 1, 3), lambda w: F.substring(w, 1, 1)), "")
    padded = F.when(F.length(initials) < 2, F.rpad(initials, 2, "X")).otherwise(initials)
    return F.concat(padded, F.upper(F.substring(F.md5(name), 1, 4)))


def semester(text: Column) -> Column:
    """The semester a text names: the first number after the word, else a roman numeral or ordinal; 1 if none."""
    digits = F.regexp_extract(text, r"(?i)(?:semester|sem(?:ester)?|term)[^\d]*(\d{1,2})", 1).try_cast("int")
    word = F.regexp_replace(F.lower(F.regexp_extract(text, _SEMESTER_WORD, 1)), r"(?<=\d)(?:st|nd|rd|th)$", "")
    named = F.try_element_at(literal_map(ROMAN | ORDINAL), word)
    return F.when(digits.isNotNull(), F.least(F.greatest(digits, F.lit(1)), F.lit(8))).otherwise(F.coalesce(named, F.lit(1)))


#: Rewrites that turn a page into text, in order.
HTML_STEPS = (
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?i)<(?:br\s*/?|/(?:p|div|tr|li|h[1-6]|ul|ol))>", "\n"),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)
#: What shows that a body is a page.
HTML_HINTS = ("<html", "<table", "<br", "<div", "<p>", "&lt;", "&gt;", "&#")


def strip_html(html: Column) -> Column:
    """The text of a page. Entities are plain strings, for which no pattern has to be searched."""

    def rewritten(text: Column, step: tuple[str, str]) -> Column:
        what, by = step
        return F.replace(text, F.lit(what), F.lit(by)) if what.startswith("&") else F.regexp_replace(text, what, by)

    return stripped(reduce(rewritten, HTML_STEPS, html))


def looks_like_html(body: Column) -> Column:
    """Whether the first 500 characters of a body hint at a page."""
    low = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500))
    return reduce(lambda a, b: a | b, (low.contains(h) for h in HTML_HINTS))


def mail_date(text: Column) -> Column:
    """An RFC 2822 date; null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def is_email(text: Column) -> Column:
    """Whether a text is a mail address."""
    return F.coalesce(F.trim(text).rlike(EMAIL), F.lit(False))


def cell_confidence(cell: Column) -> Column:
    """How far a table's cell is trusted, by its kind: blank, number, single character, anything else."""
    value = stripped(F.coalesce(cell, F.lit("")))
    blank = value.isin("", "nan", "None", "-")
    return F.when(blank, 0.50).when(value.rlike(r"^-?\d+(\.\d+)?$"), 0.97).when(F.length(value) < 2, 0.80).otherwise(0.92)


def table_text(rows: Column, number: Column) -> Column:
    """A table (rows of cells) in short: its header, five rows, and how many there are if more than six."""
    header = F.concat(F.lit("Sheet/Table "), number.cast("string"), F.lit(": "), F.array_join(F.get(rows, F.lit(0)), ", "))
    some = F.transform(F.slice(rows, 2, 5), lambda r: F.concat(F.lit("  "), F.array_join(r, " | ")))
    more = F.when(F.size(rows) > 7, F.array(F.concat(F.lit("  ... ("), (F.size(rows) - 1).cast("string"), F.lit(" total rows)")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(header), some, more), "\n")).otherwise("")


def flat_text(body: Column, rows: Column) -> Column:
    """A document's text with its tables' rows, cells joined by commas."""
    lines = F.array_join(F.transform(rows, lambda r: F.array_join(r, ", ")), "\n")
    return F.when(F.size(rows) > 0, F.concat_ws("\n", body, lines)).otherwise(body)


def marked_text(text: Column, codes: tuple[str, ...] = ()) -> Column:
    """A text with student numbers and subject codes marked and roman semesters as numbers."""
    out = F.regexp_replace(text, rf"(?i)\b({USN_SHAPES['msrit']})\b", "USN: $1")
    for code in codes:
        out = F.replace(out, F.lit(code), F.lit(f"SUBJECT_{code}"))
    for roman, number in sorted(ROMAN.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"(?i)Semester\s*[:\-]?\s*{roman}(?![IVXivx\w])", f"Semester: {number}")
    return out


def object_name(name: Column) -> Column:
    """A name that is safe as a part of a path."""
    return F.translate(F.translate(F.translate(name, "<>", ""), "\\/", "__"), " ", "_")


def json_records(reply: Column, schema: str) -> Column:
    """Records from a model's reply: a fenced or bare JSON list, a list under a known name, one object, else a list within it.

    ``schema`` describes a record; text that holds no such JSON gives an empty array.
    """
    clean = F.regexp_replace(F.regexp_replace(stripped(F.regexp_replace(reply, r"```(?:json)?\s*", "")), r"`+$", ""), r"\s+$", "")
    listed = lambda text: F.from_json(text, f"array<{schema}>")
    wrapped = F.coalesce(*(F.get_json_object(clean, f"$.{name}") for name in ("results", "data", "students", "records")))
    whole = F.when(F.try_parse_json(clean).isNotNull(), F.when(clean.startswith("["), clean).when(wrapped.startswith("["), wrapped).otherwise(F.concat(F.lit("["), clean, F.lit("]"))))
    inner = F.nullif(F.regexp_extract(clean, r"(?s)\[.*\]", 0), F.lit(""))
    return F.coalesce(listed(whole), listed(F.when(F.try_parse_json(inner).isNotNull(), inner)), listed(F.lit("[]")))


def at_path(json: Column, path: str) -> Column:
    """The value at a path such as ``a.b[0].c`` of a JSON text, as text; null where there is none."""
    return F.get_json_object(json, "$." + path)
