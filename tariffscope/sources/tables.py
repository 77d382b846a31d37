"""The audit tables as DataFrames, and ad-hoc SQL over them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tariffscope import schemas
from tariffscope.session import staged


@dataclass
class AuditTables:
    clients: DataFrame
    properties: DataFrame
    vendors: DataFrame
    accounts: DataFrame
    bills: DataFrame
    line_items: DataFrame
    audit_claims: DataFrame | None = None
    findings: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        found = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in found.items() if df is not None}

    def register_views(self) -> None:
        for name, df in self.present().items():
            df.createOrReplaceTempView(name)


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> AuditTables:
    """Read stored tables with their declared schemas; no inference pass."""
    from tariffscope.sources.store import read_table

    chosen = names or list(schemas.TABLES)
    return AuditTables(**{n: read_table(spark, folder, n) for n in chosen})


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """Scan a database table in parallel over ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


# What an ad-hoc statement may be made of, by the names Spark's analysed plans use.
ALLOWED_NODES = frozenset(
    """Aggregate CTERelationDef CTERelationRef Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset
    OneRowRelation Project Sort SubqueryAlias Union View Window WithCTE""".split()
)
ALLOWED_FUNCTIONS = frozenset(
    """Abs Add AddMonths AggregateExpression Alias And AttributeReference Average BRound Between CaseWhen Cast Ceil Coalesce CommonExpressionDef CommonExpressionRef Concat ConcatWs Contains
    Corr Count CountIf CurrentDate CurrentRow$ DateAdd DateDiff DateFormatClass DateSub DayOfMonth DayOfWeek DenseRank Divide EndsWith
    EqualNullSafe EqualTo Exists Extract Floor GetStructField GreaterThan GreaterThanOrEqual Greatest If In InSubquery IntegralDivide IsNotNull
    IsNull Lag LastDay Lead Least Length LessThan LessThanOrEqual Like ListQuery Literal Lower Max MaxBy Min MinBy Month MonthsBetween Multiply
    NTile Not NullIf NumberFormat Nvl Or OuterReference PercentRank Percentile Pmod Pow Quarter RLike Rank RegExpExtract RegExpReplace
    Remainder Right Round RowNumber RuntimeReplaceable ScalarSubquery SortOrder SpecifiedWindowFrame Sqrt StartsWith StddevPop StddevSamp
    StringRPad StringLPad StringReplace StringTrim StringTrimLeft StringTrimRight Left Substring Subtract Sum ToDate TruncDate TryCast
    UnaryMinus UnboundedFollowing$ UnboundedPreceding$ Upper VariancePop VarianceSamp WeekOfYear WindowExpression WindowSpecDefinition With Year
    ParseToDate GetTimestamp Complete$ PromotePrecision CheckOverflow ILike LikeAny LikeAll MakeDate Signum FormatNumber""".split()
)


def read_only_sql(spark: SparkSession, query: str, tables: AuditTables | None = None) -> DataFrame:
    """The rows of one SELECT over the audit views, or a one-row frame with an ``error`` column.

    The text becomes the inside of a sub-select, so nothing but a query can be parsed.
    Its analysed plan may read nothing but the audit views and values in the text, and
    use nothing but the listed functions: no files, reflection, scripts or user
    functions. The statement runs here, into the staging folder, so a failure at run
    time is an error row too.
    """
    text = query.strip().rstrip(";")
    if not text.upper().startswith("SELECT"):
        return _error(spark, "Give one SELECT statement.")
    try:
        if tables is not None:
            tables.register_views()
        found = spark.sql(f"SELECT * FROM (\n{text}\n)")
        problem = _forbidden(json.loads(found._jdf.queryExecution().analyzed().toJSON()), set(schemas.TABLES))
        return _error(spark, problem) if problem else staged(found, "answer")
    except Exception as failure:  # errors are the caller's answer
        return _error(spark, next((line for line in str(failure).splitlines() if line.strip()), type(failure).__name__))


def _forbidden(nodes: list, views: set[str]) -> str | None:
    """What a plan, as the list of its nodes in pre-order, must not hold; views that it may read aren't looked into."""
    place = 0

    def skip() -> None:
        nonlocal place
        children = nodes[place]["num-children"]
        place += 1
        for _ in range(children):
            skip()

    def node() -> str | None:
        nonlocal place
        own = nodes[place]
        name = own["class"].rsplit(".", 1)[-1]
        place += 1
        if name == "View":
            asked = own["desc"]["identifier"]["table"].lower() if isinstance(own.get("desc"), dict) else None
            if asked in views:  # what lies below a view of ours is ours, whatever it reads
                for _ in range(own["num-children"]):
                    skip()
                return None
            return f"not an audit view: {asked}"
        if name not in ALLOWED_NODES | ALLOWED_FUNCTIONS:
            return f"not allowed: {name}"
        for key, value in own.items():
            if key not in ("class", "num-children") and (problem := _inside(value, views)):
                return problem
        return next((b for b in [node() for _ in range(own["num-children"])] if b), None)

    return node()


def _inside(value, views: set[str]) -> str | None:
    """The same for plans and expressions among a node's fields."""
    if isinstance(value, list):
        if value and isinstance(value[0], dict) and "num-children" in value[0]:
            return _forbidden(value, views)
        return next((p for v in value if (p := _inside(v, views))), None)
    return None


def _error(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(message,)], "error string")
