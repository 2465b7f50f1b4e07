"""Classification of messages by keywords and by a trained model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import USN, normal_text

LABELS = ("result_email", "administrative", "spam", "other")
#: A model's label counts from this probability on.
MODEL_FROM = 0.65
#: Keywords of the pipeline's rules.
STRONG = (
    "sgpa", "cgpa", "marksheet", "scorecard", "grade card", "grade sheet", "semester result", "exam result", "internal marks", "grade points", "marks obtained", "total marks", "subject code", "subject wise",
    "result declared", "result published", "university result", "cie marks", "see marks", "semester gpa", "cumulative gpa",
)
WEAK = ("result", "marks", "grade", "usn", "pass", "fail", "subject", "semester", "1ms", "2ms", "3ms", "4ms", "backlog", "arrear", "revaluation", "re-appear")
NEGATIVE = (
    "unsubscribe", "click here to unsubscribe", "opt-out", "opt out", "internship opportunity", "job opening", "hiring", "we are hiring", "job alert", "apply now", "career", "recruitment", "newsletter", "promotional",
    "discount", "offer expires", "congratulations on your purchase", "your order", "invoice", "meeting invite", "calendar event", "zoom link", "follow us on", "social media", "linkedin", "twitter", "click to unsubscribe",
    "marketing", "sponsored", "limited time", "act now", "free trial", "sign up",
)
SUBJECT_WORDS = ("result", "marks", "marksheet", "grade", "sgpa", "cgpa")
SHEETS = (".pdf", ".xlsx", ".xls", ".csv")
#: Keywords of the classifier's own rules, for texts that no model labels.
PLAIN_STRONG = ("result", "marks", "grade", "sgpa", "cgpa", "marksheet", "semester result", "examination result", "backlog", "grade card", "transcript", "internal marks", "pass", "fail")
PLAIN_WEAK = ("exam", "test", "score", "performance", "academic", "gpa", "percentage", "assessment")
PLAIN_NEGATIVE = ("unsubscribe", "promotional", "offer", "discount", "click here", "prize", "winner", "free")


def count_of(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords a text holds."""
    return sum((F.when(text.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))


def _ruled(rules: list[tuple[Column, str, Column]], label: str, confidence: float) -> dict[str, Column]:
    name, value = F.lit(label), F.lit(confidence)
    for condition, n, v in reversed(rules):
        name, value = F.when(condition, n).otherwise(name), F.when(condition, v).otherwise(value)
    return {"label": name, "confidence": F.round(value, 2)}


def by_keywords(mails: DataFrame, subject: str, body: str, attachments: str | None = None) -> DataFrame:
    """label (result_email or other) and confidence from counts of keywords, student numbers and attached sheets (an array of file names)."""
    said = F.lower(F.concat_ws(" ", F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(body), F.lit(""))))
    names = F.coalesce(F.col(attachments), F.array().cast("array<string>")) if attachments else F.array().cast("array<string>")
    rows = mails.withColumns({"strong": count_of(said, STRONG), "weak": count_of(said, WEAK), "negative": count_of(said, NEGATIVE), "numbered": said.rlike(rf"(?i)\b{USN}\b"), "topical": count_of(F.lower(F.coalesce(F.col(subject), F.lit(""))), SUBJECT_WORDS) > 0})
    sheet = F.exists(names, lambda n: F.lower(n).rlike(r"(?:%s)$" % "|".join(x.replace(".", r"\.") for x in SHEETS)))
    strong, weak = F.col("strong"), F.col("weak")
    rules = [
        (F.col("negative") >= 2, "other", F.lit(0.1)),
        (strong >= 1, "result_email", F.least(F.lit(0.95), 0.70 + strong * 0.08 + weak * 0.03)),
        (F.col("numbered") & (weak >= 2), "result_email", F.least(F.lit(0.90), 0.65 + weak * 0.05)),
        (F.col("numbered") & sheet, "result_email", F.lit(0.85)),
        (sheet & (weak >= 2), "result_email", F.lit(0.75)),
        (F.col("topical") & (weak >= 2), "result_email", F.least(F.lit(0.85), 0.60 + weak * 0.04)),
    ]
    return rows.withColumns(_ruled(rules, "other", 0.1)).drop("strong", "weak", "negative", "numbered", "topical")


def by_plain_keywords(texts: DataFrame, text: str) -> DataFrame:
    """label (result_email, spam or other) and confidence by the classifier's own rules, over the first 1000 characters of a text."""
    low = F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 1000))
    rows = texts.withColumns({"strong": count_of(low, PLAIN_STRONG), "weak": count_of(low, PLAIN_WEAK), "negative": count_of(low, PLAIN_NEGATIVE)})
    strong, weak = F.col("strong"), F.col("weak")
    rules = [
        (F.col("negative") > 0, "spam", F.lit(0.85)),
        (strong >= 2, "result_email", F.least(F.lit(0.90), 0.75 + strong * 0.05)),
        (strong == 1, "result_email", 0.65 + weak * 0.05),
        (weak >= 2, "result_email", F.lit(0.50)),
    ]
    return rows.withColumns(_ruled(rules, "other", 0.60)).drop("strong", "weak", "negative")


#: Steps from a plain text to its words and pairs of words.
_TERMS = (
    "if(plain = '', cast(array() as array<string>), split(plain, ' ')) AS words",
    "concat(words, zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))) AS terms",
)


def fit_classifier(rows: DataFrame, text: str = "text", label: str = "label", terms: int = 5000) -> PipelineModel:
    """Multinomial regression on log-scaled TF-IDF of words and word pairs, classes weighted alike.

    ``label`` holds whole numbers from 0. The ``terms`` that most texts hold are kept.
    """
    counts = rows.groupBy(label).count()
    shape = counts.agg(F.sum("count"), F.count("*")).first()
    weighted = rows.join(F.broadcast(counts), label).withColumn("weight", F.lit(shape[0]) / (F.lit(shape[1]) * F.col("count"))).drop("count").withColumn("plain", normal_text(F.coalesce(F.col(text), F.lit(""))))
    words = [SQLTransformer(statement=f"SELECT *, {said} FROM __THIS__") for said in _TERMS]
    split = PipelineModel(words).transform(weighted)
    counter = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=terms).fit(split)
    # Texts are taken apart for the vocabulary and for these counts; what follows reads the counts.
    counted = counter.transform(split).select(label, "weight", "counts").persist()
    later = [
        IDF(inputCol="counts", outputCol="weighted_terms"),
        Normalizer(inputCol="weighted_terms", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", family="multinomial", regParam=0.001, maxIter=60),
    ]
    fitted = Pipeline(stages=later).fit(counted)
    counted.unpersist()
    return PipelineModel([*words, counter, *fitted.stages])


def predicted(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the model's predicted label number and its probability."""
    out = model.transform(rows.withColumn("plain", normal_text(F.coalesce(F.col(text), F.lit("")))))
    return out.select(*(out[c] for c in rows.columns), F.col("prediction").cast("int").alias("predicted"), F.array_max(vector_to_array("probability")).alias("certainty"))


def classified(model: PipelineModel, names: list[str], mails: DataFrame, subject: str, body: str, attachments: str | None = None) -> DataFrame:
    """Label and confidence of mails: the model's where it is certain enough, else the keyword rules'."""
    joined = mails.withColumn("_text", F.substring(F.concat_ws(" ", F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(body), F.lit(""))), 1, 1000))
    told = predicted(model, by_keywords(joined, subject, body, attachments), "_text")
    sure = F.col("certainty") >= MODEL_FROM
    label = F.when(sure, F.element_at(F.array(*(F.lit(n) for n in names)), F.col("predicted") + 1)).otherwise(F.col("label"))
    return told.withColumns({"label": label, "confidence": F.when(sure, F.col("certainty")).otherwise(F.col("confidence"))}).drop("_text", "predicted", "certainty")


def retrained(examples: DataFrame, more: DataFrame, names: list[str]) -> PipelineModel:
    """A model of the examples (text, label by name) and what reviewers have added or corrected; unknown labels are an error."""
    both = examples.select("text", "label").unionByName(more.select("text", "label"))
    unknown = both.filter(~F.col("label").isin(*names)).select("label").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown label: {unknown[0]['label']}")
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("label")) - 1
    return fit_classifier(both.withColumn("label", number.cast("double")))
