"""From a plain-language task description to a plan, as columns over a table of descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio

REALTIME_MS, STRONG, MODERATE = 100.0, 10.0, 3.0
#: Metrics that model search can optimise.
OPTIMISABLE = ("accuracy", "f1", "f1_macro", "roc_auc", "rmse", "fbeta")

#: What descriptions say, as patterns.
NUMBER = r"(\d+(?:\.\d+)?)"
COUNT = r"(\d[\d,]*)"
NOT_COUNTS = rf"[$€£]\s*\d[\d,.]*|{NUMBER}\s*(?:%|percent\b|x\b|times\b|ms\b|milliseconds?\b|s\b|secs?\b|seconds?\b|minutes?\b|hours?\b)|\b(?:next|last|past|coming|upcoming)\s+\d+\s+\w+|\d+\s+(?:days?|weeks?|months?|quarters?|years?)\s+ahead"
CAPACITY = [
    rf"\btop\s+{COUNT}", rf"\b(?:capacity|bandwidth|room)\s+(?:for|of)\s+(?:\w+\s+)?{COUNT}", rf"\b(?:short)?list\s+of\s+{COUNT}",
    rf"\b(?:no more than|at most|up to|maximum of|only)\s+(?:\w+\s+){{0,2}}{COUNT}", rf"\b(?:can|could|able to)\s+(?:\w+\s+){{0,2}}{COUNT}",
    rf"\b(?:call|contact|review|inspect|audit|investigate|visit|handle)s?\s+{COUNT}",
    rf"\b{COUNT}\s+\w+\s+(?:per|a|an|each|every)\s+(?:hour|shift|day|week|month|quarter|year)\b",
]
SERVING = r"latency|respon[ds]|repl(?:y|ies)|scor(?:e|ing)|serv(?:e|ing)|endpoint|inference|\bapi\b"
TRAINING = r"\b(?:re)?train"
MISS = r"\bmiss(?:es|ed|ing)?\b|\bfalse negatives?\b|\bundetected\b|\boverlook(?:ed|ing)?\b"
ALARM = r"\bfalse (?:positives?|alarms?)\b|\bwasted (?:calls?|visits?|reviews?|contacts?)\b|\bunnecessary (?:calls?|visits?|reviews?)\b"
NEVER_MISS = r"(?:can't|cannot|can not|mustn't|must not|never) (?:afford to )?miss|catch (?:every|all)\b"
NEVER_ALARM = r"(?:can't|cannot|can not) afford (?:any )?false (?:positives|alarms)"
DEAR = r"(?:is|are|would be)\s+(?:\w+\s+)?(?:expensive|costly|disruptive|damaging|worse)"
EXPLAIN = r"interpretab|explainab|\bexplain (?:\w+ ){0,3}(?:to|for)\b|black[- ]box|reason codes?|adverse action|audit trail|transparen"
FORECAST = r"\bforecast|time[- ]series|\bpredict(?:ing)? future\b|\bfuture (?:sales|demand|values?|revenue)|\bahead\b|\b(?:next|upcoming|coming) (?:\d+ )?(?:quarters?|years?|months?|weeks?)\b"
RANK = r"\brank|\bprioriti[sz]|\bshortlist\b|\btop \d|most likely"
ESTIMATE = r"\bestimat|\bhow (?:much|many)\b|\bregress"
CLASSIFY = r"\bclassif|\bdetect|\bidentif|\bflag\b|\bcategori[sz]e"
OUTLIERS = r"\boutliers?\b|\brobust\b|heavy[- ]tail"
PROTECTED = {
    "gender": r"\bgender\b|\bsex\b", "age": r"(?<![a-z])age(?![a-z])|\b(?:date of birth|birth ?dates?|year of birth|dob)\b", "genetic_information": r"\bgenetic", "race": r"\brace\b|\bracial\b", "ethnicity": r"\bethnic", "religion": r"\breligio", "disability": r"\bdisab(?:led|ilit)",
    "national_origin": r"\bnationalit|\bnational origin", "marital_status": r"\bmarital", "sexual_orientation": r"\bsexual orientation", "zip_code": r"\bzip[ _-]?codes?\b|\bpostal codes?\b", "pregnancy": r"\bpregnan", "veteran_status": r"\bveteran",
}


def normalise(text: Column) -> Column:
    """Lower case, straight quotes, single spaces; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\"")), r"\s+", " "))


def _found(t: Column, pattern: str) -> Column:
    got = F.regexp_extract(t, pattern, 1)
    return F.when(got != "", got)


def _at(t: Column, pattern: str) -> Column:
    """Place of the first match; null without one."""
    at = F.regexp_instr(t, F.lit(pattern))
    return F.when(at > 0, at)


def capacity(t: Column) -> Column:
    rest = F.regexp_replace(t, NOT_COUNTS, " ; ")
    return F.coalesce(*[F.regexp_replace(_found(rest, p), ",", "") for p in CAPACITY]).cast("int")


def latency(t: Column) -> Column:
    ms = _found(t, rf"{NUMBER}\s*(?:ms|milliseconds?)\b").cast("double")
    serving = t.rlike(SERVING) & ~t.rlike(TRAINING)
    s = _found(t, rf"{NUMBER}\s*(?:s|secs?|seconds?)\b").cast("double") * 1000
    m = _found(t, rf"{NUMBER}\s*minutes?\b").cast("double") * 60000
    return F.coalesce(ms, F.when(serving, F.coalesce(s, m)), F.when(t.rlike(r"\breal[- ]?time\b"), REALTIME_MS))


def costs(t: Column) -> tuple[Column, Column]:
    """Relative cost of a false positive and of a false negative; the error named first is the costly one."""
    miss, alarm = _at(t, MISS), _at(t, ALARM)
    named = miss.isNotNull() | alarm.isNotNull()
    miss_first = miss.isNotNull() & (alarm.isNull() | (miss < alarm))
    times = F.when(named, _found(t, rf"{NUMBER}\s*(?:x\b|times\b)").cast("double"))
    a = F.when(named, F.regexp_extract(t, rf"{NUMBER}\s*:\s*{NUMBER}", 1).try_cast("double"))
    b = F.regexp_extract(t, rf"{NUMBER}\s*:\s*{NUMBER}", 2).try_cast("double")
    one = F.lit(1.0)
    fn = F.when(times.isNotNull(), F.when(miss_first, times).otherwise(one)).when(a.isNotNull(), F.when(miss_first, a).otherwise(b))
    fp = F.when(times.isNotNull(), F.when(miss_first, one).otherwise(times)).when(a.isNotNull(), F.when(miss_first, b).otherwise(a))
    fn = F.coalesce(fn, F.when(t.rlike(NEVER_MISS), STRONG).when(t.rlike(rf"(?:{MISS})[^.;]{{0,40}}{DEAR}"), MODERATE), one)
    fp = F.coalesce(fp, F.when(t.rlike(NEVER_ALARM), STRONG).when(t.rlike(rf"(?:{ALARM})[^.;]{{0,10}}\s*{DEAR}"), MODERATE), one)
    return fp, fn


def protected(t: Column) -> Column:
    """Canonical names of protected attributes, in the order of the text."""
    hits = F.array(*[F.struct(_at(t, p).alias("at"), F.lit(name).alias("name")) for name, p in PROTECTED.items()])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h["at"].isNotNull())), lambda h: h["name"])


def plan(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with capacity_k, latency_ms, cost_fp, cost_fn, interpretable, forecast, protected, objective, robust. What a text does not say is null, 1, false, empty or classify."""
    base = df.withColumn("_t", normalise(F.col(text)))
    t = F.col("_t")
    fp, fn = costs(t)
    out = base.withColumns({"capacity_k": capacity(t), "latency_ms": latency(t), "cost_fp": fp, "cost_fn": fn, "interpretable": t.rlike(EXPLAIN), "forecast": t.rlike(FORECAST), "protected": protected(t), "robust": t.rlike(OUTLIERS)})
    objective = F.when(F.col("capacity_k").isNotNull() | t.rlike(RANK), "rank").when(F.col("forecast") | t.rlike(ESTIMATE), "estimate").when(t.rlike(CLASSIFY), "classify").otherwise("classify")
    return out.withColumn("objective", objective).drop("_t")


def metric(task: Column, imbalance: Column) -> Column:
    """The metric for a plan's columns and two facts of the data: task (regression, binary, multiclass or null) and the ratio of the class sizes, either way up."""
    r = F.when(imbalance > 1, ratio(F.lit(1.0), imbalance)).otherwise(imbalance)
    skew = F.greatest(ratio(F.col("cost_fn"), F.col("cost_fp")), ratio(F.col("cost_fp"), F.col("cost_fn"))) >= 2
    return (
        F.when(F.col("capacity_k").isNotNull(), "precision_at_k")
        .when(task == "regression", F.when(F.col("robust"), "mae").otherwise("rmse"))
        .when((task == "multiclass") | task.isNull(), "f1_macro")
        .when(skew, "fbeta").when(r.isNull(), "roc_auc").when(r < 0.05, "pr_auc").when(r < 0.3, "roc_auc").when(r < 0.8, "f1").otherwise("accuracy")
    )


def resolve(task: Column, imbalance: Column) -> list[Column]:
    """metric, search_metric (what the search optimises instead, if it cannot optimise that), beta, threshold."""
    m = metric(task, imbalance)
    r = F.when(imbalance > 1, ratio(F.lit(1.0), imbalance)).otherwise(imbalance)
    data = F.when(task == "regression", "rmse").when(task == "binary", F.when(r < 0.3, "roc_auc").otherwise("f1")).otherwise("f1_macro")
    return [m.alias("metric"), F.when(m.isin(*OPTIMISABLE), m).otherwise(data).alias("search_metric"), F.sqrt(F.col("cost_fn") / F.col("cost_fp")).alias("beta"), (F.col("cost_fp") / (F.col("cost_fp") + F.col("cost_fn"))).alias("threshold")]
