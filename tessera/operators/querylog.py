"""LOG — risk scoring and screening of a query-log table, from lexical features.

Re-aimed from a per-statement parser: the input is a table of SQL texts and
the output an audit table, built only from regular-expression column
expressions (one projection, whole-stage codegen, no Python).
This is an audit, not an enforcement point.

Known lexical limits: ``count(*)``, ``SELECT *`` and ``t.*`` are not
multiplications; GROUP BY, HAVING and the self-join test look only at the
outermost query (text inside parentheses, at any depth, is left out);
a self-join is the same table twice in that outermost FROM/JOIN list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lexical patterns (Java regex and RE2 agree on all of them).
LITERAL_OR_COMMENT = r"'(?:[^']|'')*'|--[^\n]*|/\*[\s\S]*?\*/"
QUOTED_NAME = r'"(?:[^"]|"")*"'

PIECE = r"[()]|[^()]+"
P_JOIN = r"\bJOIN\b"
P_OUTER = r"\b(?:LEFT|RIGHT|FULL)\s+(?:OUTER\s+)?JOIN\b"
P_SUBQUERY = r"\(\s*SELECT\b"
P_EXISTS = r"\bEXISTS\s*\("
P_GROUP = r"\bGROUP\s+BY\b"
P_HAVING = r"\bHAVING\b"
P_WINDOW = r"\bOVER\s*\("
P_AGG = r"\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|TOTAL)\s*\("
P_DIV = r"/"
P_NOT_MUL = r"\(\s*\*\s*\)|\bSELECT\s+(?:DISTINCT\s+)?\*|\.\*"
P_MUL = r"\*"
P_CASE = r"\bCASE\b"
P_TABLE = r"\b(?:FROM|JOIN)\s+([A-Z_][A-Z0-9_]*)"
P_READ = r"^\s*(?:SELECT|WITH|\()"
P_FORBIDDEN_VERB = (r"\b(?:INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|GRANT|REVOKE|PRAGMA|ATTACH|"
                    r"DETACH|VACUUM|COPY|MERGE|BEGIN|COMMIT|ROLLBACK)\b|\bREPLACE\s+INTO\b")
P_FORBIDDEN_FN = r"\b(?:LOAD_EXTENSION|READFILE|WRITEFILE|EDIT|FTS3_TOKENIZER)\s*\("
P_MORE_STATEMENTS = r";\s*\S"

# Risk weights and the verify threshold.
WEIGHTS = {"join": 1, "outer": 1, "subquery": 2, "exists": 1, "group": 1, "having": 2,
           "window": 2, "aggregate": 1, "division": 2, "multiplication": 1, "case": 1,
           "self_join": 2, "mismatch": 3}
VERIFY_THRESHOLD = 3
UNREADABLE_SCORE = 99


def cleaned(sql: Column) -> Column:
    """Upper-cased text with literals and comments blanked."""
    return F.upper(F.regexp_replace(sql, LITERAL_OR_COMMENT, " "))


def outermost(text: Column) -> Column:
    """The text outside all parentheses, at any depth: its pieces (brackets, and runs
    between them) are folded with a depth counter; each group leaves one blank. A
    closing bracket without an opening one is dropped."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(a, x):
        depth = F.when(x == "(", a["depth"] + 1).when(x == ")", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        kept = F.when((x == "(") & (a["depth"] == 0), F.lit(" ")).when(x.isin("(", ")") | (a["depth"] > 0), F.lit("")).otherwise(x)
        return F.struct(depth.alias("depth"), F.concat(a["out"], kept).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def features(log: DataFrame, known_tables: list[str] | None = None) -> DataFrame:
    """Lexical feature counts per entry (columns ``n_*`` / ``has_*``)."""
    u = F.col("_u")
    root = F.col("_root")
    out = (log.withColumn("_u", cleaned(F.col("sql")))
           .withColumn("_root", outermost(F.col("_u"))))
    tables = F.regexp_extract_all(root, F.lit(P_TABLE), 1)
    out = out.select(
        "query_id", "sql", "_u",
        F.regexp_count(u, F.lit(P_JOIN)).alias("n_joins"),
        (F.regexp_count(u, F.lit(P_OUTER)) > 0).alias("has_outer"),
        F.regexp_count(u, F.lit(P_SUBQUERY)).alias("n_subqueries"),
        (F.regexp_count(u, F.lit(P_EXISTS)) > 0).alias("has_exists"),
        (F.regexp_count(root, F.lit(P_GROUP)) > 0).alias("has_group_by"),
        (F.regexp_count(root, F.lit(P_HAVING)) > 0).alias("has_having"),
        (F.regexp_count(u, F.lit(P_WINDOW)) > 0).alias("has_window"),
        F.regexp_count(u, F.lit(P_AGG)).alias("n_aggregates"),
        (F.regexp_count(u, F.lit(P_DIV)) > 0).alias("has_division"),
        (F.regexp_count(F.regexp_replace(u, P_NOT_MUL, " "), F.lit(P_MUL)) > 0).alias("has_multiplication"),
        (F.regexp_count(u, F.lit(P_CASE)) > 0).alias("has_case"),
        (F.size(tables) != F.size(F.array_distinct(tables))).alias("has_self_join"),
        F.regexp_extract_all(u, F.lit(P_TABLE), 1).alias("_tables"))
    if known_tables is not None:
        known = F.array(*[F.lit(t.upper()) for t in known_tables])
        out = out.withColumn("has_mismatch", F.size(F.array_except(F.col("_tables"), known)) > 0)
    else:
        out = out.withColumn("has_mismatch", F.lit(False))
    return out.drop("_tables")


def risk_tier(log: DataFrame, known_tables: list[str] | None = None) -> DataFrame:
    """Weighted score, tier (``verify`` at ≥ 3, else ``trust``) and the signal list.
    Empty text or a non-read scores 99."""
    f = features(log, known_tables)
    w = WEIGHTS
    flag = lambda c, k: F.when(F.col(c), w[k]).otherwise(0)
    score = (F.col("n_joins") * w["join"] + flag("has_outer", "outer") + F.col("n_subqueries") * w["subquery"]
             + flag("has_exists", "exists") + flag("has_group_by", "group") + flag("has_having", "having")
             + flag("has_window", "window") + F.when(F.col("n_aggregates") > 0, w["aggregate"]).otherwise(0)
             + flag("has_division", "division") + flag("has_multiplication", "multiplication")
             + flag("has_case", "case") + flag("has_self_join", "self_join") + flag("has_mismatch", "mismatch"))
    unreadable = (F.trim(F.col("_u")) == "") | ~F.col("_u").rlike(P_READ)
    signals = F.array_compact(F.array(
        F.when(F.col("n_joins") > 0, F.concat(F.col("n_joins").cast("string"), F.lit(" join(s)"))),
        F.when(F.col("has_outer"), F.lit("outer join")),
        F.when(F.col("n_subqueries") > 0, F.concat(F.col("n_subqueries").cast("string"), F.lit(" subquery(s)"))),
        F.when(F.col("has_exists"), F.lit("EXISTS")),
        F.when(F.col("has_group_by"), F.lit("GROUP BY")),
        F.when(F.col("has_having"), F.lit("HAVING")),
        F.when(F.col("has_window"), F.lit("window function")),
        F.when(F.col("n_aggregates") > 0, F.concat(F.col("n_aggregates").cast("string"), F.lit(" aggregate(s)"))),
        F.when(F.col("has_division"), F.lit("division")),
        F.when(F.col("has_multiplication"), F.lit("multiplication")),
        F.when(F.col("has_case"), F.lit("CASE")),
        F.when(F.col("has_self_join"), F.lit("self-join")),
        F.when(F.col("has_mismatch"), F.lit("schema mismatch"))))
    final = F.when(unreadable, F.lit(UNREADABLE_SCORE)).otherwise(score)
    return f.select(
        "query_id", final.alias("score"),
        F.when(final >= VERIFY_THRESHOLD, "verify").otherwise("trust").alias("tier"),
        F.when(unreadable, F.lit("not a read query")).otherwise(F.array_join(signals, ", ")).alias("signals"))


def screen(log: DataFrame) -> DataFrame:
    """First failing rule wins: empty, several statements, not a read, forbidden
    verb, forbidden function; otherwise ok."""
    u = F.regexp_replace(cleaned(F.col("sql")), QUOTED_NAME, " NAME ")  # a quoted name is no verb
    reason = (F.when(F.col("sql").isNull() | (F.trim(u) == ""), "empty")
              .when(u.rlike(P_MORE_STATEMENTS), "several statements")
              .when(~u.rlike(P_READ), "not a read")
              .when(u.rlike(P_FORBIDDEN_VERB), "forbidden verb")
              .when(u.rlike(P_FORBIDDEN_FN), "forbidden function")
              .otherwise("ok"))
    return log.select("query_id", reason.alias("verdict"))
