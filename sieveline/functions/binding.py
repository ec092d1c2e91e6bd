"""Name a value once inside an expression.

Spark re-evaluates an expression each time it appears inside a lambda body. A one-element
``transform`` turns it into a lambda variable, which is computed once. Longer bodies are
written as SQL, which the session parses in one step however deep they are.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_sql(value: Column, var: str, body: str) -> Column:
    """``body``, a SQL expression over ``var``, applied to a column."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{var} -> {body}")), F.lit(0))


def let_sql(value: str, var: str, body: str) -> str:
    return f"get(transform(array({value}), {var} -> {body}), 0)"
