"""Fields out of a model's nearly-JSON answer, forgiving where a JSON parser would give up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jtrim

_STRING = r'((?:\\[\s\S]|[^"\\])*+)'
#: What a missing or malformed number counts as.
DEFAULT_SCORE = 5


def object_text(c: Column) -> Column:
    """The body of the first code fence, if there is a whole one; of that, the first { to the last }; else as it is."""
    fenced = c.rlike(r"^(?:(?!```)[\s\S])*+```[^\n]*+\n(?:(?!```)[\s\S])++```")
    body = F.when(fenced, jtrim(F.regexp_extract(c, r"^(?:(?!```)[\s\S])*+```[^\n]*+\n((?:(?!```)[\s\S])++)```", 1))).otherwise(c)
    found = F.regexp_extract(body, r"\{[\s\S]*\}", 0)
    return F.when(found != "", found).otherwise(body)


def int_field(c: Column, name: str) -> Column:
    """The digits behind the field's first colon; 5 if the field or its digits are missing. 7.9 gives 7, -3 gives 5."""
    digits = F.regexp_extract(c, rf'"{name}"[^:]*+:[ \t]*+([0-9]+)', 1)
    return F.coalesce(digits.try_cast("int"), F.lit(DEFAULT_SCORE))


def string_field(c: Column, name: str) -> Column:
    """The field's string, unescaped; empty if missing."""
    return unescape(F.regexp_extract(c, rf'"{name}"[^:]*+:[^"]*+"{_STRING}', 1))


def chat_content(c: Column) -> Column:
    """The first "content" behind the first "message" of a chat answer; null if there is none."""
    pattern = rf'"message"(?:(?!"content":)[\s\S])*+"content":[^"]*+"{_STRING}'
    return F.when(c.rlike(pattern), unescape(F.regexp_extract(c, pattern, 1)))


#: In this order: a line end is decoded before a backslash, as the answers' writer expects.
_ESCAPES = ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\"", '"'), ("\\\\", "\\"))


def unescape(c: Column) -> Column:
    for escaped, plain in _ESCAPES:
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def escape(c: Column) -> Column:
    for escaped, plain in (("\\\\", "\\"), (r"\"", '"'), (r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
