"""Known services by user agent, reverse DNS name and network organisation; the first entry that fits wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Service(NamedTuple):
    id: str
    family: str
    actor: str
    kind: str
    risk: int
    agents: tuple[str, ...] = ()
    dns_parts: tuple[str, ...] = ()
    dns_suffixes: tuple[str, ...] = ()
    orgs: tuple[str, ...] = ()


#: Names, risks and order decide what a service is called.
SERVICES = (
    Service("pantheon", "pantheon", "Pantheon", "platform", 10, (), ("pantheon",), (), ("pantheon",)),
    Service("google", "googlebot", "Google", "crawler", 25, ("googlebot", "google-inspectiontool", "googleother", "adsbot-google", "mediapartners-google", "apis-google"), (), ("googlebot.com", "google.com")),
    Service("bing", "bingbot", "Bing", "crawler", 25, ("bingbot", "msnbot", "bingpreview"), (), ("search.msn.com", "bing.com", "msn.com")),
    Service("meta", "facebook", "Meta", "crawler", 30, ("facebookexternalhit", "facebot", "facebookcatalog", "facebookbot", "meta-externalagent"), (), ("facebook.com", "fbsv.net", "meta.com"), ("facebook", "meta platforms")),
    Service("applebot", "applebot", "Apple", "crawler", 30, ("applebot",), (), ("applebot.apple.com", "apple.com"), ("apple",)),
    Service("duckduckgo", "duckduckbot", "DuckDuckGo", "crawler", 30, ("duckduckbot", "duckassistbot"), (), ("duckduckgo.com",), ("duck duck go", "duckduckgo")),
    Service("yahoo-slurp", "slurp", "Yahoo", "crawler", 35, ("yahoo! slurp", "yahoo slurp", "slurp"), (), ("crawl.yahoo.net", "yahoo.net", "yahoo.com"), ("yahoo",)),
    Service("ask-teoma", "teoma", "Ask", "crawler", 45, ("ask jeeves/teoma", "teoma"), (), (), ("ask.com", "iac search")),
    Service("aolbot", "aolbot", "AOL", "crawler", 40, ("aolbot", "aolbot-news"), (), (), ("aol",)),
    Service("yandex", "yandex", "Yandex", "crawler", 45, ("yandexbot", "yandeximages", "yandexaccessibilitybot"), (), ("yandex.ru", "yandex.net", "yandex.com"), ("yandex",)),
    Service("baidu", "baidu", "Baidu", "crawler", 45, ("baiduspider",), (), ("baidu.com", "baidu.jp"), ("baidu",)),
    Service("ahrefs", "ahrefs", "Ahrefs", "crawler", 45, ("ahrefsbot", "ahrefssiteaudit"), ("ahrefs",), (), ("ahrefs",)),
    Service("semrush", "semrush", "Semrush", "crawler", 45, ("semrushbot", "semrush"), ("semrush",), (), ("semrush",)),
    Service("addsearch", "addsearch", "AddSearch", "crawler", 35, ("addsearchbot",), ("addsearch",), (), ("addsearch",)),
    Service("commoncrawl", "commoncrawl", "Common Crawl", "crawler", 35, ("ccbot",), ("commoncrawl",), (), ("common crawl",)),
    Service("moz", "moz", "Moz", "crawler", 45, ("dotbot",), ("moz.com",), (), ("moz",)),
    Service("mj12", "mj12", "Majestic", "crawler", 45, ("mj12bot",), (), (), ("majestic",)),
    Service("screaming-frog", "screaming-frog", "Screaming Frog", "crawler", 50, ("screaming frog seo spider",), (), (), ("screaming frog",)),
    Service("sitebulb", "sitebulb", "Sitebulb", "crawler", 50, ("sitebulb",), (), (), ("sitebulb",)),
    Service("blexbot", "blexbot", "BLEXBot", "crawler", 50, ("blexbot",)),
    Service("openai", "openai", "OpenAI", "crawler", 40, ("gptbot", "chatgpt-user", "oai-searchbot"), (), (), ("openai",)),
    Service("anthropic", "anthropic", "Anthropic", "crawler", 40, ("claudebot", "claude-web", "claude-searchbot", "claude-user", "anthropic-ai"), (), (), ("anthropic",)),
    Service("perplexity", "perplexity", "Perplexity", "crawler", 40, ("perplexitybot", "perplexity-user"), (), (), ("perplexity",)),
    Service("amazon-quick", "amazon-quick", "Amazon Quick", "crawler", 40, ("aws-quick-on-behalf-of",)),
    Service("bytespider", "bytespider", "ByteDance", "crawler", 45, ("bytespider",), (), (), ("bytedance",)),
    Service("amazonbot", "amazonbot", "Amazon", "crawler", 40, ("amazonbot",)),
    Service("cohere", "cohere", "Cohere", "crawler", 45, ("cohere-ai", "cohere-training-data-crawler"), (), (), ("cohere",)),
    Service("diffbot", "diffbot", "Diffbot", "crawler", 45, ("diffbot",), (), (), ("diffbot",)),
    Service("youbot", "youbot", "You.com", "crawler", 45, ("youbot",), (), (), ("you.com", "yext")),
    Service("dataforseo", "dataforseo", "DataForSEO", "crawler", 45, ("dataforseobot",), (), (), ("dataforseo",)),
    Service("omgili", "omgili", "Omgili", "crawler", 45, ("omgili", "omgilibot"), (), (), ("omgili",)),
    Service("pingdom", "pingdom", "Pingdom", "monitor", 20, ("pingdom",), (), (), ("pingdom",)),
    Service("uptimerobot", "uptimerobot", "UptimeRobot", "monitor", 20, ("uptimerobot", "uptime robot"), (), (), ("uptimerobot",)),
    Service("statuscake", "statuscake", "StatusCake", "monitor", 20, ("statuscake",), (), (), ("statuscake",)),
    Service("datadog", "datadog", "Datadog", "monitor", 20, ("datadog",), (), (), ("datadog",)),
    Service("newrelic", "newrelic", "New Relic", "monitor", 20, ("newrelic", "new relic"), (), (), ("new relic",)),
    Service("aws", "aws", "AWS", "datacenter", 55, (), (), ("amazonaws.com",), ("amazon",)),
    Service("google-cloud", "google-cloud", "Google Cloud", "datacenter", 55, (), (), ("googleusercontent.com",), ("google cloud",)),
    Service("azure", "azure", "Azure", "datacenter", 55, (), (), ("azure.com", "cloudapp.net", "trafficmanager.net"), ("microsoft azure",)),
    Service("cloudflare", "cloudflare", "Cloudflare", "datacenter", 45, (), (), ("cloudflare.com",), ("cloudflare",)),
    Service("fastly", "fastly", "Fastly", "datacenter", 45, (), (), ("fastly.net",), ("fastly",)),
    Service("akamai", "akamai", "Akamai", "datacenter", 45, (), (), ("akamai.com", "akamaitechnologies.com", "akamaiedge.net"), ("akamai",)),
    Service("contabo", "contabo", "Contabo", "datacenter", 65, (), ("contabo",), (), ("contabo",)),
    Service("sqlmap", "sqlmap", "sqlmap", "malicious", 95, ("sqlmap",)),
    Service("nikto", "nikto", "Nikto", "malicious", 95, ("nikto",)),
    Service("nuclei", "nuclei", "Nuclei", "malicious", 95, ("nuclei",)),
    Service("masscan", "masscan", "masscan", "malicious", 95, ("masscan",)),
    Service("zgrab", "zgrab", "zgrab", "malicious", 90, ("zgrab", "zmap")),
    Service("dirbuster", "dirbuster", "Directory scanner", "malicious", 90, ("dirbuster", "gobuster", "ffuf", "dirsearch", "feroxbuster")),
    Service("wpscan", "wpscan", "WPScan", "malicious", 90, ("wpscan",)),
    Service("vulnerability-scanner", "vulnerability-scanner", "Vulnerability scanner", "malicious", 90, ("acunetix", "nessus", "openvas", "netsparker", "burpcollaborator", "burp suite")),
)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _first(test: Callable[[Service], list[Column]]) -> Column:
    """A struct of the first service that fits, or null."""
    out = None
    for s in SERVICES:
        if tests := test(s):
            row = F.struct(
                F.lit(s.id).alias("id"), F.lit(s.family).alias("family"), F.lit(s.actor).alias("known_actor"), F.lit(s.kind).alias("actor_type"),
                F.lit(s.risk).alias("risk_score"),
            )
            out = F.when(_any(tests), row) if out is None else out.when(_any(tests), row)
    return out


def by_user_agent(agent: Column) -> Column:
    text = F.lower(F.trim(agent))
    return _first(lambda s: [text.contains(x) for x in s.agents])


def by_reverse_dns(name: Column) -> Column:
    """By part of a host name, or its end at a label boundary; a closing dot is ignored."""
    host = F.rtrim(F.lower(F.trim(name)), F.lit("."))
    return _first(lambda s: [host.contains(x) for x in s.dns_parts] + [(host == x) | host.endswith("." + x) for x in s.dns_suffixes])


def by_network_org(org: Column) -> Column:
    text = F.lower(F.trim(org))
    return _first(lambda s: [text.contains(x) for x in s.orgs])


def _case_sql(field: str, tests: Callable[[Service], list[str]]) -> str:
    """A DuckDB expression for a field of the first service that fits."""
    text = {"family": "family", "known_actor": "actor", "actor_type": "kind"}
    value = lambda s: str(s.risk) if field == "risk_score" else f"'{getattr(s, text[field])}'"
    return f"CASE {' '.join(f'WHEN {test} THEN {value(s)}' for s in SERVICES if (test := ' OR '.join(tests(s))))} END"


def agent_sql(text: str, field: str) -> str:
    """The same by user agent as a DuckDB expression; ``text`` is lower-cased SQL."""
    return _case_sql(field, lambda s: [f"contains({text}, {x!r})" for x in s.agents])


def host_sql(text: str, field: str) -> str:
    """By host name; ``text`` is lower-cased SQL without a closing dot."""
    return _case_sql(field, lambda s: [f"contains({text}, {x!r})" for x in s.dns_parts] + [f"{text} = {x!r} OR ends_with({text}, {'.' + x!r})" for x in s.dns_suffixes])


def org_sql(text: str, field: str) -> str:
    """By network organisation; ``text`` is lower-cased SQL."""
    return _case_sql(field, lambda s: [f"contains({text}, {x!r})" for x in s.orgs])
