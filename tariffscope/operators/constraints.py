"""Table constraints checked as one query; the result lists what is violated.

Every table is scanned once. A row gives one entry for each rule it breaks by
itself and one for each key it holds. A key and all columns that refer to it are
one family: parents and children of a value meet in one group, counted apart,
which says both whether a unique value repeats and whether a reference has no
parent. Counts are partial before the only shuffle, so a hot value costs one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.schemas import RULES, TableRules


@dataclass(frozen=True)
class _Source:
    """One column of one table in its role: a rule of rows, a unique key, or a reference."""

    table: str
    column: str
    rule: str
    family: int


def _sources(tables: dict[str, DataFrame], rules: dict[str, TableRules]) -> list[_Source]:
    """All roles to check; a key and the columns that refer to it share a family."""
    families: dict[tuple, int] = {}

    def family(*key) -> int:
        return families.setdefault(key, len(families))

    found, parents = [], set()
    for name, df in tables.items():
        own = rules[name]
        found += [_Source(name, c, "NOT NULL", family(name, c, "NOT NULL")) for c in own.required if c in df.columns]
        found += [_Source(name, c, "ALLOWED VALUES", family(name, c, "ALLOWED VALUES")) for c in own.allowed if c in df.columns]
        found += [_Source(name, c, "UNIQUE", family(name, c)) for c in own.unique if c in df.columns]
        for c, (parent, key) in own.references.items():
            if c in df.columns and parent in tables:
                found.append(_Source(name, c, "FOREIGN KEY", family(parent, key)))
                parents.add((parent, key))
    # A key that is referred to without being declared unique is a family's parent all the same.
    for parent, key in sorted(parents):
        if not any(s.table == parent and s.column == key and s.rule == "UNIQUE" for s in found):
            found.append(_Source(parent, key, "PARENT", family(parent, key)))
    return found


def _entries(df: DataFrame, own: list[tuple[int, _Source]], rules: TableRules) -> DataFrame:
    """``family, source, value`` of one table, in one scan."""

    def entry(number: int, source: _Source) -> Column:
        value = F.col(source.column)
        wanted = {
            "NOT NULL": value.isNull(), "ALLOWED VALUES": ~value.isin(*rules.allowed.get(source.column, ("",))),
        }.get(source.rule, value.isNotNull())
        return F.when(
            wanted, F.struct(F.lit(source.family).alias("family"), F.lit(number).alias("source"), value.cast("string").alias("value"))
        )

    return df.select(F.explode(F.array_compact(F.array(*[entry(*x) for x in own]))).alias("e")).select("e.*")


def violations(tables: dict[str, DataFrame], rules: dict[str, TableRules] | None = None) -> DataFrame:
    """(table_name, rule, column_name, value, violations) over all given tables.

    Null keys refer to nothing and repeat nothing. References to tables that aren't
    given are not judged.
    """
    rules = rules or RULES
    sources = _sources(tables, rules)
    numbered = list(enumerate(sources))
    parts = [
        _entries(df, own, rules[name]) for name, df in tables.items() if (own := [x for x in numbered if x[1].table == name])
    ]
    counted = reduce(DataFrame.unionByName, parts).groupBy("family", "value").agg(
        *[F.count_if(F.col("source") == number).alias(f"n{number}") for number, _ in numbered]
    )

    def finding(number: int, source: _Source) -> Column | None:
        n, here = F.col(f"n{number}"), F.col("family") == source.family
        if source.rule == "PARENT":
            return None
        if source.rule == "UNIQUE":
            broken = n > 1
        elif source.rule == "FOREIGN KEY":
            held = [F.col(f"n{k}") for k, s in numbered if s.family == source.family and s.rule in ("UNIQUE", "PARENT")]
            broken = (n > 0) & (reduce(Column.__add__, held) == 0)
        else:
            broken = n > 0
        return F.when(
            here & broken,
            F.struct(
                F.lit(source.table).alias("table_name"), F.lit(source.rule).alias("rule"), F.lit(source.column).alias("column_name"),
                "value", n.cast("long").alias("violations"),
            ),
        )

    found = [x for x in (finding(*pair) for pair in numbered) if x is not None]
    return counted.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")
