"""New columns from expressions that others wrote: parsed, checked part by part, and kept only if what they give is worth it.

An expression is an SQL expression over a row's columns. Nothing of it is run
before its parse tree holds only listed kinds of nodes, listed functions (which
depend on their arguments alone, and make nothing much larger than them) and
columns of the table other than the target; the analysed plan is then held to
be one projection of the table, without any state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import check_outputs

#: The longest text and the most nodes of an expression.
MOST_TEXT, MOST_NODES = 2000, 200
FUNCTIONS = frozenset(
    "abs acos asin atan atan2 between bround cbrt ceil ceiling char_length character_length coalesce concat cos cosh datediff date_diff date_trunc day dayofmonth dayofweek dayofyear degrees exp expm1 floor greatest hour if ifnull initcap instr isnan isnotnull isnull last_day lcase least left length ln locate log log10 log1p log2 lower ltrim minute mod month months_between nanvl negative nullif nvl nvl2 pmod pow power quarter radians right rint round rtrim second sign signum sin sinh sqrt substr substring tan tanh to_date to_timestamp trim trunc try_add try_cast try_divide try_multiply try_subtract ucase unix_date upper weekday weekofyear year".split()
)
NODES = frozenset("Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive IntegralDivide EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not IsNull IsNotNull In CaseWhen If Cast Literal Like RLike StartsWith EndsWith Contains Concat Alias UnresolvedAttribute UnresolvedFunction UnresolvedAlias Between".split())
#: Kinds of plan that one projection of a table consists of.
PLANS = frozenset({"Project", "SubqueryAlias"})


class Refused(ValueError):
    """An expression that is not run, and why."""


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _walk(node, columns: set[str], used: set[str], count: int = 0) -> int:
    """Refuse what is not listed; the number of nodes so far."""
    count += 1
    if count > MOST_NODES:
        raise Refused(f"it has more than {MOST_NODES} parts")
    kind = node.getClass().getSimpleName()
    if kind not in NODES:
        raise Refused(f"{kind} is not allowed")
    if kind == "UnresolvedAttribute":
        parts = _seq(node.nameParts())
        if len(parts) != 1 or parts[0] not in columns:
            raise Refused(f"{'.'.join(parts)!r} is no column that may be used")
        used.add(parts[0])
    if kind == "UnresolvedFunction":
        parts = _seq(node.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise Refused(f"the function {'.'.join(parts)!r} is not allowed")
        if node.isDistinct() or node.filter().isDefined() or node.ignoreNulls():
            raise Refused("functions take arguments only")
    for child in _seq(node.children()):
        count = _walk(child, columns, used, count)
    return count


def checked(df: DataFrame, text: str, target: str | None = None) -> Column:
    """The column that `text` describes, or Refused with the reason. It must use a column of `df`; names are matched as written."""
    if not isinstance(text, str) or not text.strip():
        raise Refused("it is empty")
    if len(text) > MOST_TEXT:
        raise Refused(f"it has more than {MOST_TEXT} characters")
    spark = df.sparkSession
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as e:
        raise Refused(f"it cannot be read: {str(e).strip().splitlines()[0]}") from e
    used: set[str] = set()
    _walk(tree, {c for c in df.columns if c != target}, used)
    if not used:
        raise Refused("it uses no column")
    made = F.expr(text)
    try:
        plan = df.select(made.alias("made"))._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        raise Refused(f"it does not fit the table: {str(e).strip().splitlines()[0]}") from e
    whole, added = df._jdf.queryExecution().analyzed(), plan
    if added.getClass().getSimpleName() != "Project" or not all(e.deterministic() for e in _seq(added.projectList())) or not added.child().sameResult(whole):
        raise Refused("it is more than one column of the table's rows")
    return made


def add_columns(df: DataFrame, expressions: dict[str, str], target: str | None = None, most_null: float = 0.5) -> tuple[DataFrame, list[dict]]:
    """`df` with the columns that stand the checks, and (name, ok, reason) of each expression, in order.

    A name that the table has is refused. Of the rest, those that are constant or
    null in more than a share of the rows are left out (one aggregation for all).
    """
    report: dict[str, str | None] = {}
    made: dict[str, Column] = {}
    for name, text in expressions.items():
        try:
            if name in df.columns:
                raise Refused("the table has a column of this name")
            made[name] = checked(df, text, target)
            report[name] = None
        except Refused as e:
            report[name] = str(e)
    if made:
        for r in check_outputs(df.select(*[c.alias(n) for n, c in made.items()]), list(made), most_null).collect():
            if not r["ok"]:
                report[r["column"]] = "it is constant" if r["constant"] else f"it is null in {r['null_share']:.0%} of the rows"
                del made[r["column"]]
    return df.withColumns(made) if made else df, [{"name": n, "ok": why is None, "reason": why} for n, why in report.items()]
