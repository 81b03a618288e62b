"""Audits over logged statements and commands: does it write, is it allowed."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import let, strip

# Comments vanish, a quoted literal leaves one quote behind as a word break; an unclosed one runs to
# the end of the text. Possessive repeats keep the matcher from recursing on long literals.
NOISE = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|(')[^']*+(?:''[^']*+)*+(?:'|\z)"

# Words and fragments that mark a write.
SQL_WRITE_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "MERGE", "INTO", "CALL",
    "EXEC", "EXECUTE",
]
GRAPH_WRITE_WORDS = ["CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", r"LOAD\s+CSV"]
DOC_WRITE_FRAGMENTS = [
    ".insert", ".update", ".delete", ".remove", ".replace", ".save", ".drop", ".createindex", ".createcollection",
    ".renamecollection", ".bulkwrite", ".findoneandupdate", ".findoneandreplace", ".findoneanddelete", "$out", "$merge",
]

SQL_WRITE = r"(?i)\b(?:" + "|".join(SQL_WRITE_WORDS) + r")\b"
GRAPH_WRITE = r"(?i)\b(?:" + "|".join(GRAPH_WRITE_WORDS) + r")\b"
GRAPH_CALL = r"(?i)\bCALL\s+(?:dbms|apoc)\."
DOC_WRITE = "|".join(re.escape(f) for f in DOC_WRITE_FRAGMENTS)


def strip_noise(col: Column) -> Column:
    return F.regexp_replace(col, NOISE, "$1")


def writes_sql(col: Column) -> Column:
    return strip_noise(col).rlike(SQL_WRITE)


def writes_doc(col: Column) -> Column:
    return F.lower(col).rlike(DOC_WRITE)


def writes_graph(col: Column) -> Column:
    return let(strip_noise(col), lambda s: s.rlike(GRAPH_WRITE) | s.rlike(GRAPH_CALL))


_DIALECTS = {"sql": writes_sql, "doc": writes_doc, "graph": writes_graph}


def write_flags(df: DataFrame, stmt_col: str, dialect: str = "sql") -> DataFrame:
    """Add `is_write`; a null statement writes nothing."""
    flag = _DIALECTS[dialect](F.col(stmt_col))
    return df.withColumn("is_write", F.coalesce(flag, F.lit(False)))


# Rules of the two command lines; below, the texts of the reasons are fixed as well.
SHELL_FRAGMENTS = [";", "|", "&", "<", ">", "`", "$(", "${", "\\", "\n", "\r"]
CLOUD_VALUE_FLAGS = [
    "--region", "--output", "--profile", "--endpoint-url", "--query", "--ca-bundle", "--cli-read-timeout",
    "--cli-connect-timeout", "--color", "--page-size", "--max-items", "--starting-token", "--cli-input-json",
    "--cli-input-yaml",
]
CLOUD_READ_VERBS = ["describe", "list", "get", "lookup", "search", "batch-get", "head", "scan", "query"]
CLOUD_SENSITIVE = [
    "get-secret-value", "batch-get-secret-value", "get-login-password", "get-authorization-token",
    "get-password-data", "get-session-token", "get-federation-token",
]
CLOUD_DENIED_FLAGS = ["--profile", "--endpoint-url"]
CLOUD_DENIED_ARGS = ["--with-decryption"]
CLUSTER_INTERACTIVE = ["exec", "attach", "cp", "port-forward"]
CLUSTER_READ_VERBS = ["get", "describe", "logs", "top", "explain", "version", "api-resources", "api-versions"]
MAX_CLOUD_BYTES = 1200
MAX_CLUSTER_BYTES = 2000

_QUOTED = r"'([^']*)'|\"([^\"]*)\""
_TOKEN = r"(?:[^ \t'\"]++|'[^']*+'|\"[^\"]*+\")++"


def _shell_fragment(cmd: Column, quoted: bool) -> Column:
    """The first forbidden fragment of the list that the command contains, else null."""
    found = F.when(F.lit(False), F.lit(""))
    for piece in SHELL_FRAGMENTS:
        shown = json.dumps(piece) if quoted else piece
        found = found.when(F.contains(cmd, F.lit(piece)), F.lit("newline" if piece in "\r\n" else shown))
    return found


def tokens(cmd: Column) -> Column:
    """Words of a command; quotes group blanks and are dropped."""
    return F.transform(
        F.regexp_extract_all(cmd, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.regexp_replace(t, _QUOTED, "$1$2"),
    )


def _unbalanced(cmd: Column) -> Column:
    return F.regexp_replace(cmd, _QUOTED, "").rlike("['\"]")


def _bare_words(args: Column) -> Column:
    """Arguments that are neither flags nor the value of a value flag."""
    value_flags = F.array(*[F.lit(f) for f in CLOUD_VALUE_FLAGS])
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("bare"))

    def step(acc: Column, tok: Column) -> Column:
        is_flag = tok.startswith("-")
        return F.struct(
            (~acc["skip"] & F.array_contains(value_flags, tok)).alias("skip"),
            F.when(acc["skip"] | is_flag | (F.size(acc["bare"]) >= 2), acc["bare"])
            .otherwise(F.concat(acc["bare"], F.array(tok)))
            .alias("bare"),
        )

    return F.aggregate(args, start, step, lambda acc: acc["bare"])


def _verdict(reason: Column, **extra: Column) -> Column:
    return F.struct(
        reason.isNull().alias("allowed"),
        F.coalesce(reason, F.lit("ok")).alias("reason"),
        *[c.alias(n) for n, c in extra.items()],
    )


def _common(cmd: Column, max_bytes: int, quoted: bool = False) -> Column:
    piece = _shell_fragment(cmd, quoted)
    return (
        F.when(cmd == "", F.lit("empty command"))
        .when(F.octet_length(cmd) > max_bytes, F.lit(f"command exceeds {max_bytes} characters"))
        .when(piece.isNotNull(), F.concat(F.lit("shell metacharacter not allowed: "), piece))
        .when(_unbalanced(cmd), F.lit("could not parse command: unbalanced quote"))
    )


def cloud_verdict(col: Column) -> Column:
    """(allowed, reason, service, operation) of one cloud command."""

    def judge(cmd: Column, toks: Column, args: Column, bare: Column) -> Column:
        service = F.lower(F.coalesce(F.get(bare, F.lit(0)), F.lit("")))
        operation = F.lower(F.coalesce(F.get(bare, F.lit(1)), F.lit("")))
        # lower() is only safe for comparing, the reason shows the flag as written
        denied = F.filter(
            args,
            lambda t: F.split_part(F.lower(t), F.lit("="), F.lit(1)).isin(CLOUD_DENIED_FLAGS)
            | F.lower(t).isin(CLOUD_DENIED_ARGS),
        )
        first = F.get(denied, F.lit(0))
        read_verb = operation.rlike("^(?:" + "|".join(CLOUD_READ_VERBS) + ")(?:-|$)")
        reason = (
            _common(cmd, MAX_CLOUD_BYTES, quoted=True)
            .when(F.get(toks, F.lit(0)) != "aws", F.lit("only 'aws' commands are permitted"))
            .when(
                F.lower(first).isin(CLOUD_DENIED_ARGS),
                F.concat(F.lit("argument not allowed: "), first),
            )
            .when(
                first.isNotNull(),
                F.concat(F.lit("flag not allowed: "), F.split_part(first, F.lit("="), F.lit(1))),
            )
            .when(service == "", F.lit("missing AWS service (e.g. ec2, rds, s3)"))
            .when(operation == "", F.lit("missing AWS operation"))
            .when((service == "s3") & (operation == "ls"), F.lit(None))
            .when(
                service == "s3",
                F.concat(
                    F.lit("'aws s3 "),
                    operation,
                    F.lit("' is not read-only (use 'aws s3 ls' or 's3api' read calls)"),
                ),
            )
            .when(
                operation.isin(CLOUD_SENSITIVE) | ~read_verb,
                F.concat(F.lit("operation '"), operation, F.lit("' is not on the read-only allowlist")),
            )
        )
        return _verdict(reason, service=service, operation=operation)

    def with_tokens(cmd: Column) -> Column:
        return let(
            F.struct(cmd.alias("cmd"), tokens(cmd).alias("toks")),
            lambda s: let(
                F.struct(
                    s["cmd"].alias("cmd"),
                    s["toks"].alias("toks"),
                    F.slice(s["toks"], 2, F.greatest(F.size(s["toks"]), F.lit(1))).alias("args"),
                ),
                lambda u: judge(u["cmd"], u["toks"], u["args"], _bare_words(u["args"])),
            ),
        )

    return let(strip(F.coalesce(col, F.lit(""))), with_tokens)


def cluster_verdict(col: Column) -> Column:
    """(allowed, reason, verb, resource) of one cluster command."""

    def judge(s: Column) -> Column:
        cmd, toks = s["cmd"], s["toks"]
        verb = F.lower(F.coalesce(F.get(toks, F.lit(1)), F.lit("")))
        rest = F.filter(F.slice(toks, 3, F.greatest(F.size(toks), F.lit(1))), lambda t: ~t.startswith("-"))
        reason = (
            _common(cmd, MAX_CLUSTER_BYTES)
            .when(
                (F.size(toks) < 2) | (F.get(toks, F.lit(0)) != "kubectl"),
                F.lit("only 'kubectl' commands are permitted"),
            )
            .when(
                verb.isin(CLUSTER_INTERACTIVE),
                F.concat(F.lit("interactive verb not brokered: "), verb),
            )
            .when(
                ~verb.isin(CLUSTER_READ_VERBS),
                F.concat(F.lit("verb not on read-only allowlist: "), verb),
            )
        )
        ok = reason.isNull()
        return _verdict(
            reason,
            verb=F.when(ok, verb).otherwise(F.lit("")),
            resource=F.when(ok, F.lower(F.coalesce(F.get(rest, F.lit(0)), F.lit("")))).otherwise(F.lit("")),
        )

    return let(
        strip(F.coalesce(col, F.lit(""))),
        lambda cmd: let(F.struct(cmd.alias("cmd"), tokens(cmd).alias("toks")), judge),
    )


def cli_audit(df: DataFrame, cmd_col: str, tool: str = "cloud") -> DataFrame:
    """Add `allowed`, `reason` and the two words that name what the command touches."""
    verdict = {"cloud": cloud_verdict, "cluster": cluster_verdict}[tool](F.col(cmd_col))
    return df.withColumn("_verdict", verdict).select(*df.columns, "_verdict.*")
