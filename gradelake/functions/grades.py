"""Grade scales, marks to grade, coercion and clamping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grade points by scale.
SCALE_8 = {"O": 10.0, "A+": 9.0, "A": 8.0, "B+": 7.0, "B": 6.0, "C": 5.0, "P": 4.0, "F": 0.0}
SCALE_9 = {**SCALE_8, "D": 4.0}
SCALE_10 = {**SCALE_8, "NE": 0.0, "W": 0.0}
SCALE_11 = {"A+": 10.0, "A": 9.0, "A-": 8.0, "B+": 7.0, "B": 6.0, "B-": 5.0, "C+": 4.0, "C": 3.0, "C-": 2.0, "D": 1.0, "F": 0.0}
#: The scale that each kind of institution uses.
INSTITUTION_SCALES = {"vtu": SCALE_8, "msrit": SCALE_10, "autonomous": SCALE_8, "university": SCALE_11}
#: Percentage from which a grade is given, best first.
LADDER = ((90, "O"), (80, "A+"), (70, "A"), (60, "B+"), (55, "B"), (50, "C"), (40, "P"))


def literal_map(pairs: dict) -> Column:
    """A map column of fixed values."""
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def points(grade: Column, scale: dict[str, float] = SCALE_8) -> Column:
    """Grade points of a grade symbol; null where the scale lacks it."""
    return F.try_element_at(literal_map(scale), F.upper(F.trim(grade)))


def grade_of_marks(marks: Column, maximum: Column) -> Column:
    """Grade by percentage; F where the maximum isn't positive."""
    percent = 100.0 * marks / F.when(maximum > 0, maximum)
    out = F.when(maximum <= 0, F.lit("F"))
    for least, grade in LADDER:
        out = out.when(percent >= least, F.lit(grade))
    return out.otherwise(F.lit("F"))


def grade_of_points(value: Column) -> Column:
    """The best grade whose points the value reaches; F below all of them."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for grade, least in SCALE_8.items():
        out = out.when(value >= least, F.lit(grade))
    return out.otherwise(F.lit("F"))


def institution_of(text: Column) -> Column:
    """The kind of institution that a text names; the first that fits of those below."""
    low = F.lower(text)
    has = lambda *words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    return F.when(has("msrit", "ramaiah"), "msrit").when(has("vtu", "visvesvaraya"), "vtu").when(has("autonomous"), "autonomous").otherwise("university")


def institution_grade(grade: Column, institution: Column) -> Column:
    """A struct (grade, points): a grade as its institution writes it, from a symbol, a percentage or grade points.

    Whole numbers and percentages go by the ladder; other numbers up to ten to the first symbol within half a point;
    anything else stays as it is with 0 points; blank gives a blank.
    """
    g = F.upper(F.trim(F.coalesce(grade, F.lit(""))))
    number = F.when(g.rlike(r"^[0-9]+$") | g.endswith("%"), F.regexp_replace(g, "%+$", "").try_cast("double"))
    ladder = F.when(number.isNotNull(), grade_of_marks(number, F.lit(100)))
    loose = g.try_cast("double")

    def of(scale: dict[str, float]) -> Column:
        near = F.when(F.lit(False), F.lit(""))
        for symbol, value in scale.items():
            near = near.when(F.abs(loose - value) < 0.5, F.lit(symbol))
        near = F.when(loose.between(0, 10), near)
        symbol = F.when(g == "", "").when(points(g, scale).isNotNull(), g).otherwise(F.coalesce(ladder, near, g))
        value = F.when(points(g, scale).isNotNull(), points(g, scale)).when(ladder.isNotNull(), points(ladder)).otherwise(F.coalesce(points(near, scale), F.lit(0.0)))
        return F.struct(symbol.alias("grade"), F.when(g == "", 0.0).otherwise(value).alias("points"))

    out = of(INSTITUTION_SCALES["university"])
    for name in ("autonomous", "msrit", "vtu"):
        out = F.when(institution == name, of(INSTITUTION_SCALES[name])).otherwise(out)
    return out


def to_int(text: Column) -> Column:
    """A number read leniently and cut toward zero; null where it isn't one."""
    return F.trim(text).try_cast("double").try_cast("int")


def to_double(text: Column) -> Column:
    """A number with a decimal point or comma; null where it isn't one."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    """The value kept within [low, high]."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
