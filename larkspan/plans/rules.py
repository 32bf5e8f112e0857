"""Mapping programs: declared inputs, named values, a skip rule and tag rules, compiled to one projection.

Rules are Spark SQL expressions over the inputs and values, so no language of our own is parsed; Catalyst checks their types
and leaves out what no rule needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NullType, StringType, StructType

from ..sources.registry import rename_columns

#: The name under which the value that parts records is held while they are made.
PER = "_per"


@dataclass(frozen=True)
class Rule:
    """A tag: key, expression of its value (null or blank: no tag), confidence."""

    key: str
    value: str
    conf: float = 1.0


@dataclass(frozen=True)
class Program:
    inputs: Mapping[str, Sequence[str]]
    key: str
    rules: Sequence[Rule]
    values: Mapping[str, str] = field(default_factory=dict)
    skip: str = "false"
    per: str | None = None
    order: Sequence[str] = ()

    def _frame(self, df: DataFrame) -> DataFrame:
        """The inputs as texts, and with `per` all rows of a record as an array of them."""
        rows = rename_columns(df, self.inputs)
        if not self.per:
            return rows
        own = F.struct(*self.inputs)
        order = F.struct(*[F.col(c) for c in self.order], own)
        grouped = rows.groupBy(F.expr(self.per).alias(PER)).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), own.alias("r")))).alias("rows"))
        grouped = grouped.select(PER, F.transform("rows", lambda x: x["r"]).alias("rows"))
        return grouped.select(PER, "rows", *[F.get("rows", 0)[i].alias(i) for i in self.inputs])

    def _expressions(self) -> list[tuple[str, str, str | None]]:
        """(what it is, expression, kind of value that it must have) in the order in which they may read each other."""
        values = [(f"value {n}", e, None) for n, e in self.values.items()]
        return [*values, ("skip", self.skip, "boolean"), ("key", self.key, "text"), *((f"tag {r.key}", r.value, "text") for r in self.rules)]

    def check(self, df: DataFrame) -> list[str]:
        """What is wrong with the mapping for a table: missing columns, names that nothing has, values of a wrong kind, inputs and values that no rule reads.

        Spark's own analysis decides, on an empty frame: no expression is searched for names. What a rule reads through a value counts.
        """
        said = [f"no column for input {i}" for i, names in self.inputs.items() if not any(c in df.columns for c in names)]
        frame = self._frame(df.limit(0))
        for what, expr, kind in self._expressions():
            try:
                made = frame.select(F.expr(expr).alias("x")).schema["x"].dataType
            except AnalysisException as e:
                said.append(f"{what}: {(e.getCondition() or 'cannot be read').lower().replace('_', ' ')}")
                made = StringType()
            else:
                if kind == "boolean" and not isinstance(made, (BooleanType, NullType)) or kind == "text" and isinstance(made, (ArrayType, MapType, StructType)):
                    said.append(f"{what} is {made.simpleString()}")
            if what.startswith("value "):
                frame = frame.withColumn(what[6:], F.lit(None).cast(made))
        if any(": " in s for s in said):
            return said
        return said + [f"{'value' if n in self.values else 'input'} {n} is not read" for n in [*self.inputs, *self.values] if not self._reads(frame, n)]

    def _reads(self, frame: DataFrame, name: str) -> bool:
        """Does a rule, the skip rule or the key, or a value that one of them reads, or a row of the record, read a name? It does if it cannot be analysed without."""
        rest = frame.drop(name)
        if name in self.inputs and self.per:
            rest = rest.withColumn("rows", F.transform("rows", lambda r: r.dropFields(name)))
        if name == self.per or (self.per and name in self.order):
            return True
        for what, expr, _ in self._expressions():
            own = what[6:] if what.startswith("value ") else None
            try:
                rest.select(F.expr(expr))
            except AnalysisException:
                if own is None or (own != name and self._reads(frame, own)):
                    return True
        return False

    def evaluate(self, df: DataFrame) -> DataFrame:
        """key, position, k, v, conf, invalid: a row for each tag that a rule gives, in the order of the rules.

        Rows that the skip rule holds for give none; a null skip does not skip. Values over 255 characters are invalid. With `per` a record is all rows of
        one value of that expression: expressions read the inputs of its first row (by `order`), and `rows`, an array of all, as in `exists(rows, r -> r.x = '1')`.
        A value that no rule reads is not worked out: Catalyst leaves it out of the plan.
        """
        rows = self._frame(df)
        for name, expr in self.values.items():
            rows = rows.withColumn(name, F.expr(expr))
        rows = rows.filter(~F.coalesce(F.expr(self.skip), F.lit(False)))
        tags = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(r.key).alias("k"), F.expr(r.value).cast("string").alias("v"), F.lit(r.conf).alias("conf")) for i, r in enumerate(self.rules)])
        out = rows.select(F.expr(self.key).alias("key"), F.explode(tags).alias("t")).select("key", "t.*")
        return out.filter(F.length(F.trim("v")) > 0).withColumn("invalid", F.length("v") > 255)


EXAMPLE = Program(
    inputs={"order": ["l_orderkey"], "line": ["l_linenumber"], "flag": ["l_returnflag"], "status": ["l_linestatus", "status"], "amount": ["l_quantity"], "part": ["l_partkey"]},
    key="concat(order, '-', line, '-', part, '-', amount)",
    values={"many": "try_cast(amount as double) >= 25"},
    skip="flag = 'R'",
    rules=[Rule("kind", "case when many then 'bulk' else 'single' end", 0.9), Rule("ref", "concat('P', part)"), Rule("open", "case when status = 'O' then 'yes' end", 0.8)],
)

EXAMPLE_SQL = """
WITH i AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity AS key, * FROM lineitem WHERE l_returnflag <> 'R'),
t AS (
  SELECT key, 0 AS position, 'kind' AS k, CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'single' END AS v, 0.9::DOUBLE AS conf FROM i
  UNION ALL SELECT key, 1, 'ref', 'P' || l_partkey, 1.0::DOUBLE FROM i
  UNION ALL SELECT key, 2, 'open', 'yes', 0.8::DOUBLE FROM i WHERE l_linestatus = 'O')
SELECT *, len(v) > 255 AS invalid FROM t
"""

#: Line items of an order as one record, read row by row and all together.
ORDERS = Program(
    inputs={"order": ["l_orderkey"], "line": ["l_linenumber"], "flag": ["l_returnflag"], "status": ["l_linestatus"], "amount": ["l_quantity"], "part": ["l_partkey"]},
    key="concat('O', order)",
    values={"n": "size(rows)", "big": "filter(rows, r -> try_cast(r.amount as double) >= 40)", "unused": "raise_error('a value that no rule reads')"},
    skip="forall(rows, r -> r.flag = 'R')",
    rules=[
        Rule("lines", "n", 0.9), Rule("returned", "case when exists(rows, r -> r.flag = 'R') then 'some' end"), Rule("big", "nullif(array_join(transform(big, r -> concat(r.line, ':', r.part)), ','), '')", 0.8),
        Rule("status", "case when forall(rows, r -> r.status = status) then status end"), Rule("total", "cast(aggregate(rows, 0, (a, r) -> a + cast(try_cast(r.amount as double) as int)) as string)", 0.7),
    ],
    per="order", order=("line", "part", "amount"),
)

ORDERS_SQL = """
WITH r AS (SELECT l_orderkey AS o, count(*) AS n, bool_and(l_returnflag = 'R') AS skip, bool_or(l_returnflag = 'R') AS back, string_agg(CASE WHEN l_quantity >= 40 THEN l_linenumber || ':' || l_partkey END, ',' ORDER BY l_linenumber::VARCHAR, l_partkey::VARCHAR, l_quantity::VARCHAR) AS big,
  CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS status, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY l_orderkey),
t AS (SELECT 'O' || o AS key, unnest([0, 1, 2, 3, 4]) AS position, unnest(['lines', 'returned', 'big', 'status', 'total']) AS k, unnest([n::VARCHAR, CASE WHEN back THEN 'some' END, big, status, total::VARCHAR]) AS v, unnest([0.9::DOUBLE, 1.0, 0.8, 1.0, 0.7]) AS conf FROM r WHERE NOT skip)
SELECT *, len(v) > 255 AS invalid FROM t WHERE v IS NOT NULL
"""
