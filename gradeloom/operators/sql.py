"""Guarded ad-hoc SQL over the catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.catalog import Catalog


TABLES = ("projects", "files", "fingerprints", "tags", "analytics_sessions", "search_results", "dataset_entries", "documents", "style_vocabulary", "review_sheets")


class NotAQuery(ValueError):
    """The text is not a single SELECT."""


def checked_select(text: str) -> str:
    """Accepts one statement that begins with SELECT; anything else, WITH included, is refused."""
    body = re.sub(r"^(\s|--[^\n]*(\n|$)|/\*.*?\*/)+", "", text, flags=re.S).rstrip().rstrip(";")
    if not re.match(r"select\b", body, re.I):
        raise NotAQuery("only SELECT statements are allowed")
    return body


def select(c: Catalog, text: str, tables: list[str] | None = None) -> DataFrame:
    """Runs a SELECT over the catalog's tables, without touching its text and without leaving views behind.

    The tables are views of a session of their own, which shares the context but no
    names with the caller's, and can't read files by path. The text goes through Spark's
    parser as one statement, so a second one is a parse error; what begins with SELECT is no
    command, but for a script transformation, which is refused.
    """
    body = checked_select(text)
    own = c.spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
        own.conf.set(key, c.spark.conf.get(key))
    theirs = Catalog(own, c.sf_dir)
    for n in tables if tables is not None else TABLES:
        theirs.table(n).createOrReplaceTempView(n)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    parsed = own._jsparkSession.sessionState().sqlParser().parsePlan(body).treeString()
    if any(line.lstrip(" :+-'").startswith("ScriptTransformation") for line in parsed.splitlines()):
        raise NotAQuery("script transformations are not allowed")
    return own.sql(body)


def select_as_text(c: Catalog, text: str, tables: list[str] | None = None) -> DataFrame:
    """As `select`, with every value as text: null as NULL, binary as its size."""
    df = select(c, text, tables)

    def shown(f: T.StructField) -> Column:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            x = F.concat(F.lit("<blob "), F.octet_length(x).cast("string"), F.lit(" bytes>"))
        return F.coalesce(x.cast("string"), F.lit("NULL")).alias(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])
