"""REST-style table paths over registered tables, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v.replace("*", "%")),
    "ilike": lambda c, v: c.ilike(v.replace("*", "%")),
}


def resolve(path: str, table: Callable[[str], DataFrame], functions: dict[str, Callable[..., DataFrame]] | None = None, extra: str = "", span: tuple[int, int] | None = None) -> DataFrame:
    """``/<table>?select=&col=op.value&order=&limit=&offset=`` or ``/rpc/<function>``.
    ``extra``: more conditions; ``span``: the first and last row wanted."""
    parts = urlsplit(path)
    steps = [p for p in parts.path.split("/") if p]
    pairs = parse_qsl(parts.query, keep_blank_values=True) + parse_qsl(extra)
    if len(steps) == 2 and steps[0] == "rpc":
        return (functions or {})[steps[1]](**dict(pairs))
    if len(steps) != 1:
        raise ValueError(f"not a table or function: {path}")
    df, options = table(steps[0]), {"select": "*", "order": "", "limit": "", "offset": ""}
    for name, value in pairs:
        if name in options:
            options[name] = value
            continue
        op, _, operand = value.partition(".")
        kind = df.schema[name].dataType
        if op == "is":
            df = df.where(F.col(name).isNull() if operand == "null" else F.col(name) == (operand == "true"))
        elif op == "in":
            df = df.where(F.col(name).isin([F.lit(v).cast(kind) for v in operand.strip("()").split(",")]))
        elif op in COMPARE:
            df = df.where(COMPARE[op](F.col(name), operand if "like" in op else F.lit(operand).cast(kind)))
        else:
            raise ValueError(f"unknown operator {op}")
    if options["order"]:
        keys = [k.split(".") for k in options["order"].split(",")]
        df = df.orderBy(*[F.desc(k[0]) if "desc" in k[1:] else F.asc(k[0]) for k in keys])
    if span:
        options["offset"], options["limit"] = str(span[0]), str(span[1] - span[0] + 1)
    if options["offset"]:
        df = df.offset(int(options["offset"]))
    if options["limit"]:
        df = df.limit(int(options["limit"]))
    return df if options["select"] == "*" else df.select(*options["select"].split(","))
