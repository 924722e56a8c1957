"""Published address lists of well-known services. Documents are fetched elsewhere and read by ``operators.intel``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id, name, actor type, address and kind of each list. Whoever fetches microsoft-365 adds a ``clientrequestid`` of
#: their own to its address, as its publisher asks; no query here reads it.
PROVIDERS = (
    ("openai-gptbot", "OpenAI GPTBot", "crawler", "https://openai.com/gptbot.json", "json"),
    ("openai-searchbot", "OpenAI SearchBot", "crawler", "https://openai.com/searchbot.json", "json"),
    ("openai-chatgpt-user", "OpenAI ChatGPT-User", "fetcher", "https://openai.com/chatgpt-user.json", "json"),
    ("google-common-crawlers", "Google Common Crawlers", "crawler", "https://developers.google.com/crawling/ipranges/common-crawlers.json", "json"),
    ("google-special-crawlers", "Google Special Crawlers", "crawler", "https://developers.google.com/crawling/ipranges/special-crawlers.json", "json"),
    ("google-user-fetchers", "Google User-Triggered Fetchers", "fetcher", "https://developers.google.com/crawling/ipranges/user-triggered-fetchers.json", "json"),
    ("google-user-fetchers-google", "Google User-Triggered Fetchers Google", "fetcher", "https://developers.google.com/crawling/ipranges/user-triggered-fetchers-google.json", "json"),
    ("google-user-agents", "Google User-Triggered Agents", "fetcher", "https://developers.google.com/crawling/ipranges/user-triggered-agents.json", "json"),
    ("bingbot", "Bingbot", "crawler", "https://www.bing.com/toolbox/bingbot.json", "json"),
    ("duckduckbot", "DuckDuckBot", "crawler", "https://duckduckgo.com/duckduckbot.json", "json"),
    ("ahrefsbot", "AhrefsBot", "crawler", "https://api.ahrefs.com/v3/public/crawler-ip-ranges", "json"),
    ("perplexitybot", "PerplexityBot", "crawler", "https://www.perplexity.com/perplexitybot.json", "json"),
    ("perplexity-user", "Perplexity User", "fetcher", "https://www.perplexity.com/perplexity-user.json", "json"),
    ("addsearchbot", "AddSearchBot", "crawler", "https://www.addsearch.com/docs/indexing/whitelisting-addsearch-bot/", "text"),
    ("aws", "Amazon Web Services", "cloud", "https://ip-ranges.amazonaws.com/ip-ranges.json", "json"),
    ("cloudflare", "Cloudflare", "edge", "https://www.cloudflare.com/ips-v4", "text"),
    ("cloudflare-ipv6", "Cloudflare IPv6", "edge", "https://www.cloudflare.com/ips-v6", "text"),
    ("microsoft-365", "Microsoft 365", "platform", "https://endpoints.office.com/endpoints/worldwide", "json"),
    ("applebot", "Applebot", "crawler", "https://search.developer.apple.com/applebot.json", "json"),
    ("github", "GitHub", "platform", "https://api.github.com/meta", "json"),
    ("fastly", "Fastly", "edge", "https://api.fastly.com/public-ip-list", "json"),
    ("uptimerobot", "UptimeRobot", "monitor", "https://api.uptimerobot.com/meta/ips", "json"),
    ("pingdom-ipv4", "Pingdom IPv4", "monitor", "https://my.pingdom.com/probes/ipv4", "text"),
    ("pingdom-ipv6", "Pingdom IPv6", "monitor", "https://my.pingdom.com/probes/ipv6", "text"),
    ("stripe", "Stripe", "payment", "https://docs.stripe.com/ips.md", "text"),
    ("paypal", "PayPal", "payment", "https://www.paypal.com/us/cshelp/article/what-are-the-internet-protocol-ip-addresses-for-paypal-server-endpoints-ts1056", "text"),
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The lists as files <folder>/<id>, with who publishes them: input of ``intel.provider_ranges``."""
    from pyspark.sql import functions as F

    known = spark.createDataFrame(list(PROVIDERS), "provider_id string, provider_name string, actor_type string, source_url string, kind string")
    bodies = spark.read.text(folder, wholetext=True).select(
        F.col("value").alias("body"), F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.\w+)?$", 1).alias("provider_id"),
    )
    return bodies.join(F.broadcast(known), "provider_id")  # the list above
