"""Security-probe classification of requests, as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import let

#: Words and patterns that name a probe.
ADMIN_TOOL = ("phpmyadmin", "/pma", "adminer", "/xmlrpc.php", "/wp-admin/install.php", "/wp-admin/setup-config.php")
PASSWORD_RESET = (
    "lostpassword", "lost-password", "retrievepassword", "resetpass", "forgot_password", "forgot-password", "passwordreset", "reset_password",
    "request-password-reset",
)
PASSWORD_RESET_START = ("/password/reset", "/password/email", "/reset-password", "/forgot-password", "/account/reset")
ADMIN_LOGIN = ("controller=adminlogin", "submitlogin", "adminlogin")
ADMIN_PATH = ("/wp-login.php", "/wp-admin", "/administrator", "/admin", "/login", "/user/login", "/backend", "/manager")
CANDIDATE = (
    ".env", "wp-config.php", "composer.json", "composer.lock", "id_rsa", ".git/",
    "union", "select", "information_schema", "sleep(", "benchmark(", "extractvalue(",
    "updatexml(", "concat(", " or 1=1", " and 1=1", "+or+1%3d", "+and+1%3d",
    "--", "/*", "2d%2d", "2f%2a", "<script", "3cscript", "javascript:",
    "onerror=", "onload=", "alert(", "/etc/passwd", "proc/self/environ", "boot.ini",
    "..", "2e%2e",
)
SELECT_FROM = r"(^|[^a-z0-9_])select(%20|\+|\s)+[^&]{0,240}(%20|\+|\s)+from([^a-z0-9_]|$)"
TAUTOLOGY = r"""(^|[^a-z0-9_])(or|and)(\s|%20|\+|/\*[^*]*\*/)+['"]?([0-9]+|true)(\s|%20|\+|/\*[^*]*\*/)*(=|%3d|like)(\s|%20|\+|/\*[^*]*\*/)*['"]?([0-9]+|true)([^a-z0-9_]|$)"""
TRAVERSAL = r"(^|[^.])(\.\.(/|%2f|%5c)|%2e%2e(/|%2f|%5c))"
QUOTED_OR = ("%25%27%20or%20", "%27%20or%20", "%27+or+")
COMMENT = ("--", "%2d%2d", "/*", "%2f%2a", "%2f**")
KEYWORD = ("select", "union", "information_schema", "concat(", "sleep(", "benchmark(", "extractvalue(", "updatexml(")
SECRET_FILE = ("/.env", "wp-config.php", "composer.json", "composer.lock", "id_rsa", "/.git/")
SYSTEM_FILE = ("/etc/passwd", "proc/self/environ", "boot.ini")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words, in a single pass."""
    return text.rlike("|".join(map(re.escape, words)))


def variants(value: Column) -> Column:
    """The lower-cased value and what up to two rounds of URL decoding make of it, without repeats; a value
    that cannot be decoded, or does not change, ends the rounds."""
    decoded = lambda first: let(F.try_url_decode(first), lambda d: F.array_distinct(F.array_compact(F.array(first, F.lower(d), F.when(d != first, F.lower(F.try_url_decode(F.lower(d))))))))
    # without a percent or plus sign, decoding changes nothing
    return let(F.lower(F.trim(F.coalesce(value, F.lit("")))), lambda first: F.when(first.contains("%") | first.contains("+"), decoded(first)).otherwise(F.array(first)))


def _texts(path: Column, query: Column) -> tuple[Column, Column, Column]:
    p, q = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(query, F.lit("")))
    return p, q, F.when(q == "", p).otherwise(F.concat(p, F.lit("?"), q))


def admin_category(method: Column, path: Column, query: Column, status: Column) -> Column:
    p, _, target = _texts(path, query)
    start = reduce(lambda a, b: a | b, [p.startswith(x) for x in PASSWORD_RESET_START])
    login = (F.upper(method) == "POST") & (p.contains("/login") | (p == "/wp-login.php") | any_of(target, ADMIN_LOGIN))
    return (
        F.when(any_of(p, ADMIN_TOOL), "admin_tool")
        .when(any_of(target, PASSWORD_RESET) | start, "password_reset")
        .when(login, "admin_login")
        .when(p.contains("/wp-admin/admin-ajax.php") & status.between(200, 399), None)
        .when(any_of(p, ADMIN_PATH), "admin_path")
    )


def injection(path: Column, query: Column) -> Column:
    """(category, reason) of the first rule that fits, or null. SQL rules are tried on all variants of the
    target before others, variant by variant."""
    p, q, target = _texts(path, query)
    gate = F.exists(F.concat(variants(p), variants(q), variants(F.concat(p, F.lit("?"), q))), lambda v: any_of(v, CANDIDATE))
    row = lambda category, reason: F.struct(F.lit(category).alias("category"), reason.alias("reason"))
    first = lambda tries, rule: F.get(F.filter(F.transform(tries, rule), lambda x: x.isNotNull()), F.lit(0))

    def rules(tries: Column) -> Column:
        secret = F.exists(tries, lambda v: any_of(v, SECRET_FILE)) | F.exists(variants(p), lambda v: v.startswith("/.env"))
        system = F.exists(tries, lambda v: v.rlike(TRAVERSAL) | any_of(v, SYSTEM_FILE))
        files = F.when(secret, row("secret_file", F.lit("secret_file"))).when(system, row("path_traversal", F.lit("path_traversal")))
        script = let(first(tries, _script_reason), lambda reason: F.when(reason.isNotNull(), row("xss", reason)).otherwise(files))
        return let(first(tries, _sql_reason), lambda reason: F.when(reason.isNotNull(), row("sql_injection", reason)).otherwise(script))

    return F.when(gate, let(variants(target), rules))


def _script_reason(v: Column) -> Column:
    return F.when(any_of(v, ("<script", "3cscript")), "script_tag").when(any_of(v, ("javascript:", "onerror=", "onload=", "alert(")), "xss_payload")


def _sql_reason(v: Column) -> Column:
    return (
        F.when(v.contains("union") & v.contains("select"), "union_select")
        .when(any_of(v, (";select", "3bselect")) | v.rlike(SELECT_FROM), "select_from")
        .when(v.contains("information_schema"), "information_schema")
        .when(any_of(v, ("sleep(", "benchmark(")), "time_delay_function")
        .when(any_of(v, ("extractvalue(", "updatexml(", "concat(")), "sql_function")
        .when(any_of(v, QUOTED_OR) | v.rlike(TAUTOLOGY), "tautology")
        .when(any_of(v, COMMENT) & any_of(v, KEYWORD), "sql_comment_with_keyword")
    )


def classified(events: DataFrame) -> DataFrame:
    """``events`` with __probes: what each is a probe of, once for each family: family, category, rule_key, match_reason."""
    admin = admin_category(F.col("method"), F.col("path"), F.col("query"), F.col("status"))
    tried = events.withColumns({"__admin": admin, "__injection": injection(F.col("path"), F.col("query"))})
    rows = F.array(
        F.when(F.col("__admin").isNotNull(), F.struct(F.lit("admin").alias("family"), F.col("__admin").alias("category"), F.concat(F.lit("admin_"), "__admin").alias("rule_key"), F.lit("").alias("match_reason"))),
        F.when(F.col("__injection").isNotNull(), F.struct(F.lit("injection").alias("family"), F.col("__injection.category").alias("category"), F.concat(F.lit("probe_"), "__injection.category").alias("rule_key"), F.col("__injection.reason").alias("match_reason"))),
    )
    return tried.select(*events.columns, F.array_compact(rows).alias("__probes"))


def probes(events: DataFrame) -> DataFrame:
    """The events that are probes, once for each family, with family, category, rule_key and match_reason."""
    return classified(events).select(*events.columns, F.inline("__probes"))


def errors(events: DataFrame) -> DataFrame:
    """Error facts: status 400 and up."""
    return events.where("status >= 400")


def slow(events: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Slow-request facts."""
    return events.where(F.col("request_time_ms") >= least_ms)
