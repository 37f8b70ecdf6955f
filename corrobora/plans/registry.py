"""Where queries and their SQL counterparts are registered."""

from pyspark.sql import DataFrame, functions as F, types as T

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, folder) -> DataFrame`` and, if it has one, its SQL counterpart."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: export(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def export(df: DataFrame) -> DataFrame:
    """Plain column types: money as double, text lists joined, counters as bigint."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(columns)


def with_ctes(*parts):
    """WITH clause from (name, body) fragments, each name once, in order."""
    seen = {}
    for part in parts:
        for name, body in part:
            seen.setdefault(name, body)
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in seen.items()) + "\n"
