"""Checker replies (JSON) to flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schema of a reply; unknown fields are ignored.
MESSAGES = "messages array<struct<severity string,data string,pos struct<line:int,`column`:int>>>"
REPLY = f"error string, response struct<env:int,error:string,{MESSAGES.replace('array<struct<severity string,data string,', 'array<struct<severity:string,data:string,').replace('pos struct', 'pos:struct').replace('messages array', 'messages:array')}>"


def _any(messages: Column, test) -> Column:
    return F.coalesce(F.exists(messages, lambda m: F.coalesce(test(m), F.lit(False))), F.lit(False))


def reply_flags(c: Column) -> Column:
    """struct(has_error, is_valid_no_sorry, is_valid_with_sorry) of a client reply: an error text, an unreadable or
    missing response, or an error message make it an error; a sorry warning only the first kind of valid."""
    r = F.from_json(c, REPLY)
    failed = r.isNull() | (F.coalesce(r["error"], F.lit("")) != "") | r["response"].isNull()
    error = failed | _any(r["response"]["messages"], lambda m: m["severity"] == "error")
    sorry = _any(r["response"]["messages"], lambda m: m["data"].contains("declaration uses 'sorry'"))
    error = F.coalesce(error, F.lit(True))
    return F.struct(error.alias("has_error"), (~error & ~sorry).alias("is_valid_no_sorry"), (~error).alias("is_valid_with_sorry"))


def inner_has_error(c: Column, accept_sorry: bool = True) -> Column:
    """Of an inner response: the presence of a key error or stderr, null or not, is an error; so are messages of
    severity error, and sorry warnings unless accepted."""
    keys = F.json_object_keys(c)
    messages = F.from_json(c, MESSAGES)["messages"]
    bad = F.coalesce(F.arrays_overlap(keys, F.array(F.lit("error"), F.lit("stderr"))), F.lit(False)) | _any(messages, lambda m: m["severity"] == "error")
    if not accept_sorry:
        bad = bad | _any(messages, lambda m: (m["severity"] == "warning") & m["data"].contains("declaration uses 'sorry'"))
    return bad


def normal_messages(c: Column) -> Column:
    """Messages with defaults for what is missing."""
    messages = F.from_json(c, REPLY)["response"]["messages"]
    return F.transform(F.coalesce(messages, F.array().cast("array<struct<severity:string,data:string,pos:struct<line:int,column:int>>>")), lambda m: F.struct(F.coalesce(m["severity"], F.lit("info")).alias("severity"), F.coalesce(m["data"], F.lit("")).alias("data"), F.coalesce(m["pos"]["line"], F.lit(0)).alias("line")))


def readable(c: Column) -> Column:
    """Whether a text is JSON at all."""
    return F.try_parse_json(c).isNotNull()


def as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})
