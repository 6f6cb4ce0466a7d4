"""TXT — cleaning model output as columns. Every helper is Column -> Column,
built from JVM expressions so a whole cleaning projection stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the ASCII whitespace class, spelled out so Java regex and RE2
# (the oracle's engine) agree on it.
WS = r"[\t\n\x0B\f\r ]+"


def one_line(c: Column) -> Column:
    """Fold whitespace: runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(c, f"^{WS}|{WS}$", "")


def strip_fences(c: Column) -> Column:
    """Drop a leading code-fence line and a trailing one; text that does not
    start with a fence is only stripped."""
    t = strip(c)
    no_first = F.regexp_replace(t, r"^```[^\n]*(\n|$)", "")
    no_last = F.regexp_replace(no_first, r"(^|\n)[ \t\x0B\f\r]*```[^\n]*$", "")
    return F.when(t.startswith("```"), strip(no_last)).otherwise(t)


# Answer labels removed after the fences, each tried once, in order.
SQL_LABELS = ("sql:", "SQL:", "Query:", "query:")


def strip_sql(c: Column) -> Column:
    t = strip(strip_fences(c))
    for label in SQL_LABELS:
        t = F.when(t.startswith(label), strip(F.substring(t, len(label) + 1, 1 << 30))).otherwise(t)
    return t


def json_loose(c: Column) -> Column:
    """Parse as JSON; else parse the span from the first ``{`` to the last ``}``;
    else NULL. Returns a VARIANT."""
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    span = F.when((first > 0) & (F.instr(F.reverse(c), "}") > 0) & (last > first),
                  F.substring(c, first, last - first + 1))
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(span))


def unit_interval(x: Column, is_bool: bool = False) -> Column:
    """Scale repair: a boolean is 0/1; 1 < x ≤ 100 is a percentage; then clamp to [0, 1]."""
    if is_bool:
        return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    v = x.cast("double")
    v = F.when((v > 1) & (v <= 100), v / 100.0).otherwise(v)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def first_line(c: Column, type_name: Column) -> Column:
    """First line of an error message, or the error's type name when empty."""
    line = F.split(strip(F.coalesce(c, F.lit(""))), "\n").getItem(0)
    return F.coalesce(F.nullif(strip(line), F.lit("")), type_name)


def prompt_hint(question: Column, evidence: Column) -> Column:
    ev = strip(F.coalesce(evidence, F.lit("")))
    return F.when(ev == "", question).otherwise(F.concat(question, F.lit("\n\nHint: "), ev))


def signature(tool: Column, tables: Column, sql: Column) -> Column:
    """Canonical key of an action: lower-cased fields, sorted lists, folded SQL."""
    return F.concat_ws("|", F.lower(tool), F.array_join(F.sort_array(F.transform(tables, lambda x: F.lower(x))), ","),
                       F.lower(one_line(sql)))
