"""User-agent analysis as one struct-valued Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.catalog import by_user_agent
from tidemark.functions.columns import let

#: Patterns in the order in which they are tried.
BROWSERS = (
    ("Microsoft Edge", r"(?i)EdgA?/([\d.]+)"),
    ("Opera", r"(?i)OPR/([\d.]+)"),
    ("Samsung Internet", r"(?i)SamsungBrowser/([\d.]+)"),
    ("Chrome iOS", r"(?i)CriOS/([\d.]+)"),
    ("Firefox iOS", r"(?i)FxiOS/([\d.]+)"),
    ("Firefox", r"(?i)Firefox/([\d.]+)"),
    ("Chrome", r"(?i)(?:Chrome|Chromium)/([\d.]+)"),
    ("Safari", r"(?i)Version/([\d.]+).*Safari/"),
    ("Internet Explorer", r"(?i)MSIE\s([\d.]+)"),
    ("Internet Explorer", r"(?i)Trident/.*rv:([\d.]+)"),
)
TOOLS = (
    ("curl", r"(?i)curl/([\d.]+)"),
    ("Wget", r"(?i)Wget/([\d.]+)"),
    ("python-requests", r"(?i)python-requests/([\d.]+)"),
    ("aiohttp", r"(?i)aiohttp/([\d.]+)"),
    ("go-http-client", r"(?i)Go-http-client/([\d.]+)"),
    ("okhttp", r"(?i)okhttp/([\d.]+)"),
    ("java-client", r"(?i)Java/([\d.]+)"),
)
SYSTEMS = (
    ("Windows", r"(?i)Windows NT ([\d.]+)"),
    ("macOS", r"(?i)Mac OS X ([\d_]+)"),
    ("iOS", r"(?i)(?:iPhone|CPU) OS ([\d_]+)"),
    ("Android", r"(?i)Android ([\d.]+)"),
    ("Chrome OS", r"(?i)CrOS [^ ]+ ([\d.]+)"),
)
WINDOWS = {"10.0": "10/11", "6.3": "8.1", "6.2": "8", "6.1": "7"}


def _named(sample: Column, patterns: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Name and captured version of the first pattern that is found; '' for none."""
    name = version = None
    for label, pattern in patterns:
        hit = sample.rlike(pattern)
        capture = F.regexp_extract(sample, pattern, 1)
        name = F.when(hit, label) if name is None else name.when(hit, label)
        version = F.when(hit, capture) if version is None else version.when(hit, capture)
    return name.otherwise(""), version.otherwise("")


def three_parts(version: Column) -> Column:
    return F.array_join(F.slice(F.split(version, r"\."), 1, 3), ".")


def volume_risk(requests: Column) -> Column:
    return F.when(requests >= 10000, 60).when(requests >= 1000, 45).otherwise(30)


def analyse(agent: Column, requests: Column | None = None) -> Column:
    """family, browser_family, browser_version, os_family, os_version, device_family, actor_type, known_actor,
    is_bot, is_tool, risk_score. Null counts as empty; ``requests`` sets the risk of the unknown."""
    first = F.struct(F.trim(F.coalesce(agent, F.lit(""))).alias("sample"), volume_risk(requests if requests is not None else F.lit(0)).alias("volume"))
    return let(first, lambda x: F.when(x["sample"] == "", _struct_of_empty()).otherwise(let(_parts(x), _analysis)))


def _parts(x: Column) -> Column:
    """What the patterns find in a sample."""
    sample = x["sample"]
    found = {"browser": _named(sample, BROWSERS), "tool": _named(sample, TOOLS), "os": _named(sample, SYSTEMS)}
    token = F.lower(F.regexp_extract(sample, r"^[/;() ]*([^/;() ]+)", 1))
    return F.struct(
        F.lower(sample).alias("lower"), by_user_agent(sample).alias("service"), x["volume"].alias("volume"), token.alias("token"),
        *(c.alias(f"{n}{suffix}") for n, pair in found.items() for c, suffix in zip(pair, ("", "_version"), strict=True)),
    )


def _analysis(x: Column) -> Column:
    lower, service, browser, tool, raw = x["lower"], x["service"], x["browser"], x["tool"], x["os_version"]
    os_name = F.when(x["os"] != "", x["os"]).when(lower.contains("linux"), "Linux").otherwise("")
    windows = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in WINDOWS.items() for v in pair]), raw), raw)
    os_version = F.when(os_name == "Windows", windows).when(os_name.isin("macOS", "iOS"), F.translate(raw, "_", ".")).otherwise(three_parts(raw))
    device = (
        F.when(lower.rlike("ipad|tablet"), "Tablet")
        .when(lower.rlike("mobile|iphone|android"), "Mobile")
        .when(os_name.isin("Windows", "macOS", "Linux", "Chrome OS"), "Desktop")
        .otherwise("unknown")
    )
    is_tool, known, is_browser, crawler = tool != "", service.isNotNull(), browser != "", lower.rlike("bot|spider|crawler")
    risk = F.coalesce(service["risk_score"], x["volume"])
    kind = F.coalesce(service["actor_type"], F.when(is_tool, "tool").when(is_browser, "browser").when(crawler, "crawler").otherwise("unknown"))
    return F.struct(
        F.when(is_tool, tool).when(known, service["family"]).when(is_browser, browser).when(crawler, "generic-crawler").when(x["token"] == "", "unknown").otherwise(x["token"]).alias("family"),
        browser.alias("browser_family"),
        F.when(is_tool & (x["tool_version"] != ""), three_parts(x["tool_version"])).otherwise(three_parts(x["browser_version"])).alias("browser_version"),
        os_name.alias("os_family"),
        os_version.alias("os_version"),
        device.alias("device_family"),
        kind.alias("actor_type"),
        F.coalesce(service["known_actor"], F.lit("")).alias("known_actor"),
        (kind == "crawler").alias("is_bot"),
        (is_tool | kind.isin("tool", "monitor")).alias("is_tool"),
        F.when(is_tool, F.when(risk < 60, 65).otherwise(risk)).when(known, risk).when(is_browser, F.when(risk > 30, 15).otherwise(risk)).when(crawler, F.greatest(risk, F.lit(50))).otherwise(risk).cast("int").alias("risk_score"),
    )


def _struct_of_empty() -> Column:
    return F.struct(
        F.lit("empty").alias("family"), *(F.lit("").alias(n) for n in ("browser_family", "browser_version", "os_family", "os_version")), F.lit("unknown").alias("device_family"),
        F.lit("missing").alias("actor_type"), F.lit("").alias("known_actor"), F.lit(False).alias("is_bot"), F.lit(False).alias("is_tool"), F.lit(55).alias("risk_score"),
    )


FIELDS = ("family", "browser_family", "browser_version", "os_family", "os_version", "device_family", "actor_type", "known_actor", "is_bot", "is_tool", "risk_score")


def merge_stored(stored: Column, computed: Column) -> Column:
    """A stored analysis, with gaps filled from a computed one; families that only name a kind count as gaps."""
    kind = F.lower(F.trim(F.coalesce(stored["actor_type"], F.lit(""))))

    def text(n: str) -> Column:
        value = F.lower(F.trim(F.coalesce(stored[n], F.lit(""))))
        gap = value.isin(
            "", "unknown", "browser", "tool", "crawler", "bot",
        ) | ((kind != "") & (value == kind)) if n == "family" else value.isin("", "unknown") if n in ("actor_type", "device_family") else value == ""
        return F.when(gap, computed[n]).otherwise(stored[n]).alias(n)

    flag = lambda n: F.coalesce(stored[n] | computed[n], stored[n], computed[n]).alias(n)
    return F.struct(
        *(text(n) for n in FIELDS[:8]), flag("is_bot"), flag("is_tool"),
        F.when(stored["risk_score"] > 0, stored["risk_score"]).otherwise(computed["risk_score"]).alias("risk_score"),
    )
