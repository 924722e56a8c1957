"""Kinds of bots, as shown to users, from a user agent's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bot names by kind, tried in this order, and actors of the same kind.
KINDS = (
    ("ai", r"\b(gptbot|chatgpt-user|oai-searchbot|claudebot|claude-web|claude-searchbot|claude-user|anthropic-ai|perplexitybot|perplexity-user|bytespider|amazonbot|aws-quick-on-behalf-of|google-extended|googleother|googleother-image|googleother-video|applebot-extended|meta-externalagent|facebookbot|diffbot|imagesiftbot|cohere-ai|cohere-training-data-crawler|omgili|omgilibot|youbot|ccbot)\b", ("amazon quick", "anthropic", "bytedance", "cohere", "diffbot", "openai", "perplexity", "you.com")),
    ("search", r"\b(googlebot|bingbot|msnbot|duckduckbot|duckassistbot|applebot|yandexbot|baiduspider|slurp|teoma|aolbot|ask jeeves)\b", ("google", "bing", "microsoft", "duckduckgo", "apple", "yandex", "baidu", "yahoo", "ask", "aol")),
    ("seo", r"\b(ahrefsbot|ahrefssiteaudit|semrushbot|semrush|dotbot|mj12bot|blexbot|screaming frog seo spider|sitebulb|addsearchbot|dataforseobot)\b", ("ahrefs", "semrush", "moz", "majestic", "blexbot", "screaming frog", "sitebulb", "addsearch", "dataforseo")),
    ("social", r"\b(facebookexternalhit|facebot|facebookcatalog|facebookbot|meta-externalagent|twitterbot|linkedinbot|slackbot-linkexpanding|slackbot)\b", ("meta", "facebook", "x", "twitter", "linkedin", "slack")),
    ("monitors", r"\b(uptimerobot|uptime robot|pingdom|statuscake|datadog|newrelic|new relic)\b", ("uptimerobot", "pingdom", "statuscake", "datadog", "newrelic", "new relic")),
    ("tools", r"\b(curl|wget|go-http-client|python-requests|python-urllib|aiohttp|scrapy|okhttp|postmanruntime|axios|node-fetch|java)\b", ()),
)
SUSPECT_AGENT = r"(?i)python|curl|scrapy|aiohttp|scanner|sqlmap|nikto|nuclei|masscan|zgrab|gobuster|ffuf|dirsearch|feroxbuster"
SUSPECT_SOURCE = r"(?i)scanner|abuse|malicious"


def bot_kind(family: Column, known_actor: Column, actor_type: Column, sample: Column, reverse_dns: Column, risk: Column, manual_action: Column) -> Column:
    """ai, search, seo, social, monitors, tools, suspicious or other."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.lower(F.concat_ws(" ", *map(blank, (family, known_actor, actor_type, sample, reverse_dns))))
    known, kind = F.lower(blank(known_actor)), F.lower(blank(actor_type))
    actor = F.lower(F.trim(F.when(blank(known_actor) != "", known_actor).otherwise(blank(family))))
    out = None
    for name, pattern, actors in KINDS:
        hit = text.rlike(pattern)
        if name == "ai":
            hit = hit | known.isin(*actors) | F.lower(blank(family)).isin(*(a.replace(" ", "-").replace(".", "-") for a in actors))
        elif actors:
            hit = hit | actor.isin(*actors)
        if name in ("monitors", "tools"):
            hit = hit | (kind == name[:-1])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    suspect = (blank(manual_action) == "suspicious") | (F.coalesce(risk, F.lit(0)) >= 70) | text.rlike(SUSPECT_AGENT) | F.concat_ws(
        " ", blank(actor_type), blank(known_actor), blank(reverse_dns),
    ).rlike(SUSPECT_SOURCE)
    return out.when(suspect, "suspicious").otherwise("other")
