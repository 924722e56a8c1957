"""Log-line parsing, as Columns; access lines out of the ordinary by one Arrow function."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from ipaddress import IPv4Address, IPv6Address, ip_address, ip_network
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions.columns import let

ACCESS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("client_ip", "method", "scheme", "host", "path", "query")]
    + [T.StructField("status", T.IntegerType()), T.StructField("bytes_sent", T.LongType()), T.StructField("referer", T.StringType()), T.StructField("user_agent", T.StringType()), T.StructField("request_time_ms", T.IntegerType()), T.StructField("upstream_time_ms", T.IntegerType())]
)
MOST_MS = 86_400_000
_NOT_PUBLIC = [
    ip_network(x) for x in (
        "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32", "fc00::/7", "::1/128", "fe80::/10", "::/128",
    )
]
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_BAD_ESCAPE = re.compile(r"%(?![0-9a-fA-F]{2})")


def clean_line(line: Column) -> Column:
    """Without white space around and a byte-order mark before it."""
    return F.trim(F.regexp_replace(F.trim(line), "^\ufeff", ""))


def split_fields(line: str) -> list[str]:
    """Fields between blanks; quotes go, what they hold stays together, as does what stands in brackets; a
    backslash inside quotes takes the next character as it is; fields of nothing vanish."""
    out, field, quoted, bracket, taken = [], [], False, False, False
    for c in line:
        if taken:
            field.append(c)
            taken = False
        elif quoted and c == "\\":
            taken = True
        elif c == '"':
            quoted = not quoted
        elif c in " \t" and not quoted and not bracket:
            if field:
                out.append("".join(field))
                field = []
        else:
            bracket = bracket if quoted else c == "[" or (bracket and c != "]")
            field.append(c)
    return [*out, "".join(field)] if field else out


def address(text: str) -> IPv4Address | IPv6Address | None:
    text = text.strip().strip("[]")
    if text.count(":") == 1:
        text = text.split(":")[0]
    try:
        return ip_address(text)
    except ValueError:
        return None


def is_public(ip: IPv4Address | IPv6Address) -> bool:
    return not any(ip.version == n.version and ip in n for n in _NOT_PUBLIC)


def client_ip(fields: list[str]) -> str:
    """The first public address in the comma lists, the last field's list first; else the first address there or in
    the first field."""
    listed = [p for f in reversed(fields) if "," in f for p in f.split(",")]
    known = [ip for p in listed if (ip := address(p))]
    best = next((ip for ip in known if is_public(ip)), None) or next(iter(known), None) or (address(fields[0]) if fields else None)
    return str(best) if best else ""


def split_target(target: str) -> tuple[str, str, str, str]:
    """(path, query, scheme, host). Paths are decoded; a question mark that decoding uncovers starts the
    query; targets that are no URL are cut at their first question mark."""
    bare, mark, query = target.partition("#")[0].partition("?")
    try:
        absolute = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", bare)
        if _CONTROL.search(target) or bare.startswith(":") or ":" in bare.split("/")[0] and not absolute:
            raise ValueError(target)
        parts = urlsplit(bare) if absolute or bare.startswith("//") else None
        path, scheme, host = (parts.path, parts.scheme, parts.netloc.rpartition("@")[2]) if parts else (bare, "", "")
        if parts and absolute and not bare[absolute.end() :].startswith("/"):
            path = ""
        if _BAD_ESCAPE.search(path):
            raise ValueError(target)
        path, _, inner = unquote(path, errors="surrogateescape").encode("utf-8", "surrogateescape").decode("utf-8", "replace").partition("?")
        query = "&".join(x for x in (inner, query) if x)
        return path or "/", query, scheme if absolute else "", host if absolute else ""
    except ValueError:
        path, _, query = target.partition("?")
        return path or "/", query, "", ""


def duration_ms(text: str) -> int:
    """Milliseconds of seconds; of a list the most, 0 if any part is no positive number; '-' parts do not count."""
    most = 0
    for part in text.split(",") if "," in text else [text]:
        part = part.strip()
        if part in ("", "-"):
            continue
        try:
            seconds = float(part)
        except ValueError:
            return 0
        if "_" in part or not 0 < seconds < math.inf:
            return 0
        most = max(most, min(MOST_MS, max(1, math.floor(seconds * 1000 + 0.5))))
    return most


def _whole(text: str, lo: int, hi: int) -> int:
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and lo <= int(text) <= hi else 0


def parse_access(line: str) -> tuple | None:
    """The fields of one access line, or None. Positions count from the request, wherever it stands."""
    fields = split_fields(line)
    at = next((i for i, f in enumerate(fields) if " HTTP/" in f or f.startswith(("GET ", "POST "))), 0)
    if len(fields) < 7 or not 0 < at < len(fields) - 2:
        return None
    request, rest = fields[at].split(" "), fields[at + 3 :] + [""] * 4
    path, query, scheme, host = split_target(request[1]) if len(request) > 1 else ("", "", "", "")
    dash = lambda x: "" if x == "-" else x
    return (
        client_ip(fields), request[0] if len(request) > 1 else "", scheme, host, path, query, _whole(fields[at + 1], 0, 999),
        _whole(fields[at + 2], -(1 << 63), (1 << 63) - 1), dash(rest[0]), dash(rest[1]), duration_ms(rest[2]), duration_ms(rest[3]),
    )


@pandas_udf(ACCESS)
def access_fields(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Arrow-batched ``parse_access``; a row of nulls for lines that are none."""
    none = None
    for batch in lines:
        if not batch.notna().any():  # most batches of plain lines: one frame of nulls serves all of a length
            if none is None or len(none) != len(batch):
                none = pd.DataFrame({f.name: pd.array([None] * len(batch), dtype="string" if f.dataType == T.StringType() else "Int64") for f in ACCESS.fields})
            yield none
            continue
        rows = [parse_access(x) if x else None for x in batch]
        yield pd.DataFrame({f.name: pd.array([r[k] if r else None for r in rows], dtype="string" if f.dataType == T.StringType() else "Int64") for k, f in enumerate(ACCESS.fields)})


_NUMBER = r"(?:-|\d{1,9}(?:\.\d{1,9})?)"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
#: An access line whose fields need no more than cutting: digits and dots for an address, or none, a plain target, no escapes,
#: nothing left out.
ORDINARY = (
    r"^([0-9.]+|-) [^\s\"\[\]\\,]+ [^\s\"\[\]\\,]+ \[[^\]\"\\,]+\] "
    r"\"([A-Z]+) (/(?!/)[^\s\"\\%#?,\x00-\x20\x7f]*|/)(?:\?([^\s\"\\#,\x00-\x20\x7f]*))? HTTP/[0-9.]+\" "
    rf"(\d{{1,3}}) (-|\d{{1,18}}) \"([^\"\\\x01]+)\" \"([^\"\\\x01]+)\"(?: ({_NUMBER}))?(?: ({_NUMBER}))?$"
)
#: A comma with what might be an address on a side: such lines may name the client behind proxies.
_LISTED = r"[0-9a-fA-F:.\]]\s*,|,\s*[0-9a-fA-F:.\[]"


def is_ordinary(line: Column) -> Column:
    return F.coalesce(line.rlike(ORDINARY) & ~line.rlike(_LISTED), F.lit(False))


def ordinary_fields(line: Column) -> Column:
    """What ``parse_access`` makes of an ordinary line, from one match: its groups with a sign between that it cannot hold."""
    return let(F.split(F.regexp_replace(line, ORDINARY, "\x01".join(f"${k}" for k in range(1, 11))), "\x01", -1), _cut_fields)


def _cut_fields(cut: Column) -> Column:
    part = lambda k: F.get(cut, F.lit(k - 1))
    dash = lambda c: F.when(c == "-", "").otherwise(c)

    def ms(text: Column) -> Column:
        seconds = text.try_cast("double")
        whole = F.least(F.lit(MOST_MS).cast("double"), F.greatest(F.lit(1.0), F.floor(seconds * 1000 + 0.5).cast("double")))
        return F.when(F.coalesce(seconds, F.lit(0.0)) > 0, whole).otherwise(0).cast("int")

    values = {
        "client_ip": F.when(part(1).rlike(_IPV4), part(1)).otherwise(""), "method": part(2), "scheme": F.lit(""), "host": F.lit(""), "path": part(3), "query": part(4), "status": part(5).cast("int"),
        "bytes_sent": F.coalesce(part(6).try_cast("long"), F.lit(0).cast("long")), "referer": dash(part(7)), "user_agent": dash(part(8)), "request_time_ms": ms(part(9)), "upstream_time_ms": ms(part(10)),
    }
    return F.struct(*(c.alias(n) for n, c in values.items()))


def access_time(line: Column) -> Column:
    """The first bracketed time anywhere, else the first field as an ISO time with zone; null if neither."""
    text = clean_line(line)
    bracket = F.regexp_extract(text, r"\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]", 1)
    first = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2}))(?:[ \t]|$)", 1)
    return F.when(bracket != "", F.try_to_timestamp(bracket, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).when(first != "", _iso(first))


def _iso(text: Column) -> Column:
    """ISO times, with or without zone (UTC then), and with zones that lack their colon."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"), " ", "T"))


def severity(name: Column) -> Column:
    text = F.lower(F.trim(name))
    return F.when(
        text.isin("emerg", "alert", "crit", "critical", "fatal", "panic"), "critical",
    ).when(text.isin("err", "error"), "error").when(text.isin("warn", "warning"), "warning").when(text == "", "info").otherwise(text)


def severity_of(message: Column) -> Column:
    """By the first bracketed word, else by words in the text."""
    lower, bracket = F.lower(message), F.regexp_extract(message, r"\[([A-Za-z]+)\]", 1)
    return F.when(bracket != "", severity(bracket)).when(lower.rlike("fatal|critical|panic"), "critical").when(lower.rlike("error|exception"), "error").when(lower.contains("warn"), "warning").when(
        lower.contains("note") | lower.contains("notice"), "notice",
    ).otherwise("info")


#: The line formats in the order in which they are tried.
NGINX = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\[([a-z]+)\]\s*(.*)$"
APACHE = r"^\[[A-Z][a-z]{2} ([A-Z][a-z]{2})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2})((?:\.\d+)?) (\d{4})\]\s*(.*)$"
PHP = r"^\[([0-9]{2}-[A-Za-z]{3}-[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})(?: [A-Z]{2,4})?\]\s*(.*)$"
ISO = r"^(\d{4}-\d{2}-\d{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.\d+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)\s*(.*)$"
MYSQL_LONG = r"^(\d{4}-\d{2}-\d{2})\s+(\d{1,2}:\d{2}:\d{2})\s*(.*)$"
MYSQL_SHORT = r"^(?:# Time:\s*)?(\d{6})\s+(\d{1,2}:\d{2}:\d{2})\s*(.*)$"


def parse_log(line: Column) -> Column:
    """(ts, severity, message) of an error, PHP or database line; null for others."""
    return let(F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\r+$", ""), _parsed)


def _parsed(raw: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(raw, pattern, k)
    hour = lambda pattern, k: F.lpad(part(pattern, k), 8, "0")

    def read(pattern: str, ts: Column, level: Column, message: Column) -> Column:
        return F.when(raw.rlike(pattern) & ts.isNotNull(), F.struct(ts.alias("ts"), level.alias("severity"), F.trim(message).alias("message")))

    apache = F.concat_ws(
        " ", part(APACHE, 1), F.lpad(part(APACHE, 2), 2, "0"),
        F.concat(part(APACHE, 3), F.rpad(F.when(part(APACHE, 4) == "", ".").otherwise(part(APACHE, 4)), 7, "0")), part(APACHE, 5),
    )
    return F.coalesce(
        read(NGINX, F.try_to_timestamp(part(NGINX, 1), F.lit("yyyy/MM/dd HH:mm:ss")), severity(part(NGINX, 2)), part(NGINX, 3)),
        read(APACHE, F.try_to_timestamp(apache, F.lit("MMM dd HH:mm:ss.SSSSSS yyyy")), severity_of(part(APACHE, 6)), part(APACHE, 6)),
        read(PHP, F.try_to_timestamp(part(PHP, 1), F.lit("dd-MMM-yyyy HH:mm:ss")), severity_of(part(PHP, 2)), part(PHP, 2)),
        read(ISO, _iso(part(ISO, 1)), severity_of(part(ISO, 2)), part(ISO, 2)),
        read(MYSQL_LONG, F.try_to_timestamp(F.concat_ws(" ", part(MYSQL_LONG, 1), hour(MYSQL_LONG, 2)), F.lit("yyyy-MM-dd HH:mm:ss")), severity_of(part(MYSQL_LONG, 3)), part(MYSQL_LONG, 3)),
        read(MYSQL_SHORT, F.try_to_timestamp(F.concat_ws(" ", part(MYSQL_SHORT, 1), hour(MYSQL_SHORT, 2)), F.lit("yyMMdd HH:mm:ss")), severity_of(part(MYSQL_SHORT, 3)), part(MYSQL_SHORT, 3)),
    )


def _log_name(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]+)$", 1)), r"\.gz$", "")


def _web_server(name: Column) -> list[tuple[Column, str]]:
    return [
        (name.startswith("nginx-access.log"), "nginx-access"), (name.startswith("nginx-error.log"), "nginx-error"),
        (name.startswith("php-error.log") | name.startswith("php-fpm-error.log"), "php-error"), (name.startswith("php-slow.log"), "php-slow"),
    ]


def _database(name: Column) -> list[tuple[Column, str]]:
    return [(name.contains("slow") & name.contains("mysql"), "mysql-slow"), (name.contains("mysql"), "mysql")]


def _apache(name: Column, local: bool) -> list[tuple[Column, str]]:
    end = lambda kind: name.rlike(rf"[-_]{kind}\.log") if local else F.lit(False)
    return [(name.startswith(f"apache-{kind}.log") | end(kind), f"apache-{kind}") for kind in ("access", "error")]


def _choose(tests: list[tuple[Column, str]]) -> Column:
    out = F
    for test, kind in tests:
        out = out.when(test, kind)
    return out.otherwise("unknown")


def hosted_log_type(path: Column) -> Column:
    """The kind of log by its file name, as hosting platforms name them."""
    name = _log_name(path)
    return _choose(_web_server(name) + _database(name) + _apache(name, False))


def local_log_type(path: Column) -> Column:
    """The same, with names such as ``shop-access.log`` taken for Apache logs if nothing else fits."""
    name = _log_name(path)
    return _choose(_web_server(name) + _database(name) + _apache(name, True))


def combined_log_type(path: Column) -> Column:
    """The kind of log when raw files are combined: database logs only by the start of their names."""
    name = _log_name(path)
    database = [
        (name.startswith("mysql-slow.log") | name.startswith("mysqld-slow-query.log"), "mysql-slow"),
        (name.startswith("mysql.log") | name.startswith("mysqld.log"), "mysql"),
    ]
    return _choose(_web_server(name) + database + _apache(name, True))


def is_access(log_type: Column) -> Column:
    return log_type.isin("nginx-access", "apache-access")
