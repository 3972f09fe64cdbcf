"""Callbacks from where they are registered to where they are invoked: equi-joins on names and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_name


def dataflow(registered: DataFrame, stored: DataFrame, invoked: DataFrame) -> DataFrame:
    """path, callback, field, invoker, register_line, store_line, invoke_line of every flow within a file.

    registered: path, line, api, callback. stored: path, line, function, field. invoked: path, line, function, field.
    A callback handed to a function that stores its argument in a field flows to whoever calls the field. Of
    several places of one flow the first line of each kind is kept, so that repeated lines make no pairs.
    """
    r = registered.groupBy("path", short_name(F.col("api")).alias("fn"), "callback").agg(F.min("line").alias("register_line"))
    s = stored.groupBy("path", short_name(F.col("function")).alias("fn"), "field").agg(F.min("line").alias("store_line"))
    i = invoked.groupBy("path", "field", F.col("function").alias("invoker")).agg(F.min("line").alias("invoke_line"))
    return r.join(s, ["path", "fn"]).join(i, ["path", "field"]).select("path", "callback", "field", "invoker", "register_line", "store_line", "invoke_line")


def _worst(*statuses: Column) -> Column:
    """active only if all are."""
    return F.when(F.greatest(*((s != "active").cast("int") for s in statuses)) == 0, "active").otherwise("conditional")


def _firmest(*keys: Column) -> tuple[list[Column], Column]:
    return list(keys), F.when(F.max((F.col("build_status") == "active").cast("int")) == 1, "active").otherwise("conditional").alias("build_status")


def handed_on(handed: DataFrame, stored: DataFrame, invoked: DataFrame) -> DataFrame:
    """path, line, caller, function, symbol, field, invoker, build_status: a name handed to a function that keeps it in a field.

    handed: path, line, caller, callee, symbol, build_status. stored: path, function, symbol, field, build_status.
    invoked: path, function, field, build_status. Flows stay within a file; a name handed over is the one stored. Each
    side is folded to its distinct keys before the joins; of several places the first line and the firmest status count.
    """
    short = lambda c: short_name(F.col(c))
    keys, firm = _firmest(F.col("path"), F.col("caller"), short("callee").alias("fn"), short("symbol").alias("sym"))
    h = handed.groupBy(*keys).agg(F.min("line").alias("line"), firm)
    keys, firm = _firmest(F.col("path"), F.col("function"), short("function").alias("fn"), short("symbol").alias("sym"), F.col("field"))
    s = stored.groupBy(*keys).agg(F.min("symbol").alias("symbol"), firm.alias("s"))
    keys, firm = _firmest(F.col("path"), F.col("field"), F.col("function").alias("invoker"))
    i = invoked.groupBy(*keys).agg(firm.alias("i"))
    met = h.join(s, ["path", "fn", "sym"]).join(i, ["path", "field"])
    return met.select("path", "line", "caller", "function", "symbol", "field", "invoker", _worst(F.col("build_status"), F.col("s"), F.col("i")).alias("build_status"))


def forwarded(handed: DataFrame, ends: DataFrame) -> DataFrame:
    """path, line, creator, between, function, setup, symbol, build_status: a name handed to its end, through one function at most.

    handed as in ``handed_on``; ends: path, function, setup, symbol, build_status. A direct flow (between is null) hides
    those through another function of the same creator.
    """
    short = lambda c: short_name(F.col(c))
    keys, firm = _firmest(F.col("path"), F.col("caller"), short("callee").alias("fn"), short("symbol").alias("sym"))
    h = handed.groupBy(*keys).agg(F.min("line").alias("line"), firm)
    keys, firm = _firmest(F.col("path"), F.col("function"), short("function").alias("fn"), F.col("setup"), short("symbol").alias("sym"))
    e = ends.groupBy(*keys).agg(F.min("symbol").alias("symbol"), firm.alias("e"))
    one = h.join(e, ["path", "fn", "sym"]).withColumn("status", _worst(F.col("build_status"), F.col("e")))
    direct = one.select("path", "line", F.col("caller").alias("creator"), F.lit(None).cast("string").alias("between"), "function", "setup", "symbol", "status")
    last = one.select("path", short("caller").alias("fn"), "sym", F.col("caller").alias("between"), "function", "setup", "symbol", "status")
    two = h.join(last, ["path", "fn", "sym"]).select("path", "line", F.col("caller").alias("creator"), "between", "function", "setup", "symbol", _worst(F.col("build_status"), F.col("status")).alias("status"))
    kept = direct.unionByName(two).groupBy("path", "creator", "function", "setup", "symbol").agg(F.min(F.struct(F.col("between").isNotNull().alias("far"), "line", "between", "status")).alias("x"))
    return kept.select("path", "x.line", "creator", "x.between", "function", "setup", "symbol", F.col("x.status").alias("build_status"))


def paired(names: DataFrame, name: str, suffix: str = "FromISR") -> DataFrame:
    """Functions that exist with and without a suffix: plain, special."""
    special = names.filter(F.endswith(name, F.lit(suffix))).select(F.col(name).alias("special")).distinct()
    plain = names.select(F.col(name).alias("plain")).distinct()
    return special.join(plain, F.regexp_replace("special", suffix + "$", "") == F.col("plain")).select("plain", "special")
