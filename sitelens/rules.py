"""Rule packs: technology fingerprints and opportunity rules as plain data.

A pack is configuration (tens to hundreds of entries), so it lives on the driver
and becomes literal column expressions. ``*_rows`` turn a pack into tables for
validation and for joins; ``fingerprints_from_rows`` does the reverse.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Signal(NamedTuple):
    type: str
    name: str | None
    pattern: str
    version_group: int | None
    confidence: str
    # Lower-case literals of which every match holds at least one. They let a
    # page skip the pattern after a plain substring test; empty = always run.
    needles: tuple[str, ...] = ()


class Fingerprint(NamedTuple):
    id: str
    name: str
    category: str
    signals: tuple[Signal, ...]


class Condition(NamedTuple):
    kind: str
    check_id: str | None = None
    analyzer: str | None = None
    key: str | None = None
    value: str | None = None


class OpportunityRule(NamedTuple):
    id: str
    title: str
    category: str
    urgency: str
    requires: tuple[Condition, ...]
    template: str
    pitch: str
    evidence_from: tuple[str, ...] = ()
    supersedes: tuple[str, ...] = ()


def html(pattern, confidence, *needles, group=None):
    return Signal("html", None, pattern, group, confidence, needles)


def header(name, pattern, confidence="certain", group=None):
    return Signal("header", name, pattern, group, confidence)


def cookie(name, confidence="certain", pattern=None):
    return Signal("cookie", name, pattern or name, None, confidence)


def generator(pattern, group=None):
    return Signal("meta_generator", None, pattern, group, "certain")


# --- fixed values: fingerprints --------------------------------------------------
FINGERPRINTS = (
    Fingerprint("wordpress", "WordPress", "cms", (
        generator(r"WordPress\s*([\d.]+)?", 1),
        html(r"/wp-content/", "certain", "/wp-content/"),
        html(r"/wp-includes/", "certain", "/wp-includes/"),
        header("x-pingback", r"xmlrpc\.php", "likely"))),
    Fingerprint("drupal", "Drupal", "cms", (
        generator(r"Drupal\s*([\d.]+)?", 1),
        html(r"/sites/default/files/", "likely", "/sites/default/files/"),
        header("x-drupal-cache", r"."),
        header("x-generator", r"Drupal\s*([\d.]+)?", group=1))),
    Fingerprint("joomla", "Joomla", "cms", (
        generator(r"Joomla!?\s*([\d.]+)?", 1),
        html(r"/media/jui/", "likely", "/media/jui/"),
        html(r"option=com_content", "likely", "option=com_content"))),
    Fingerprint("wix", "Wix", "cms", (
        html(r"static\.parastorage\.com", "certain", "static.parastorage.com"),
        generator(r"Wix\.com"),
        header("x-wix-request-id", r"."))),
    Fingerprint("squarespace", "Squarespace", "cms", (
        html(r"static1\.squarespace\.com", "certain", "static1.squarespace.com"),
        header("server", r"Squarespace"))),
    Fingerprint("webflow", "Webflow", "cms", (
        generator(r"Webflow"),
        html(r"assets\.website-files\.com", "certain", "assets.website-files.com"))),
    Fingerprint("ghost", "Ghost", "cms", (
        generator(r"Ghost\s*([\d.]+)?", 1),
        html(r"/assets/built/", "possible", "/assets/built/"))),
    Fingerprint("typo3", "TYPO3", "cms", (
        generator(r"TYPO3\s*([\d.]+)?", 1),
        html(r"/typo3conf/", "certain", "/typo3conf/"))),
    Fingerprint("contentful", "Contentful", "cms", (
        html(r"images\.ctfassets\.net", "likely", "images.ctfassets.net"),)),
    Fingerprint("craft_cms", "Craft CMS", "cms", (
        header("x-powered-by", r"Craft CMS"),
        cookie("CraftSessionId"))),
    Fingerprint("woocommerce", "WooCommerce", "ecommerce", (
        html(r"/plugins/woocommerce/", "certain", "/plugins/woocommerce/"),
        html(r"woocommerce-page|wc-block", "likely", "woocommerce-page", "wc-block"),
        generator(r"WooCommerce\s*([\d.]+)?", 1))),
    Fingerprint("shopify", "Shopify", "ecommerce", (
        html(r"cdn\.shopify\.com", "certain", "cdn.shopify.com"),
        header("x-shopify-stage", r"."),
        html(r"Shopify\.theme", "certain", "shopify.theme"))),
    Fingerprint("magento", "Magento", "ecommerce", (
        html(r"/static/version\d+/frontend/", "certain", "/static/version"),
        cookie("X-Magento-Vary"),
        html(r"Mage\.Cookies", "likely", "mage.cookies"))),
    Fingerprint("prestashop", "PrestaShop", "ecommerce", (
        generator(r"PrestaShop"),
        cookie("PrestaShop"))),
    Fingerprint("bigcommerce", "BigCommerce", "ecommerce", (
        html(r"cdn\d*\.bigcommerce\.com", "certain", ".bigcommerce.com"),)),
    Fingerprint("opencart", "OpenCart", "ecommerce", (
        html(r"index\.php\?route=common/home", "likely", "index.php?route=common/home"),
        cookie("OCSESSID"))),
    Fingerprint("squarespace_commerce", "Squarespace Commerce", "ecommerce", (
        html(r"squarespace-commerce", "likely", "squarespace-commerce"),)),
    Fingerprint("react", "React", "javascript", (
        html(r"react(?:-dom)?[.@-]([\d.]+)?[.\w]*\.js", "likely", "react", group=1),
        html(r"data-reactroot|__NEXT_DATA__|_reactListening", "certain",
             "data-reactroot", "__next_data__", "_reactlistening"))),
    Fingerprint("nextjs", "Next.js", "framework", (
        html(r"/_next/static/", "certain", "/_next/static/"),
        header("x-powered-by", r"Next\.js"))),
    Fingerprint("vue", "Vue.js", "javascript", (
        html(r"vue(?:\.runtime)?[.@-]([\d.]+)?[.\w]*\.js", "likely", "vue", group=1),
        html(r"data-v-[0-9a-f]{8}", "certain", "data-v-"))),
    Fingerprint("nuxt", "Nuxt", "framework", (
        html(r"__NUXT__|/_nuxt/", "certain", "__nuxt__", "/_nuxt/"),)),
    Fingerprint("angular", "Angular", "javascript", (
        html(r'ng-version="([\d.]+)"', "certain", "ng-version=", group=1),
        html(r"ng-app|angular\.min\.js", "likely", "ng-app", "angular.min.js"))),
    Fingerprint("svelte", "Svelte", "javascript", (
        html(r"svelte-[0-9a-z]{6}", "likely", "svelte-"),)),
    Fingerprint("jquery", "jQuery", "javascript", (
        html(r"jquery[.-]?([\d]+\.[\d]+(?:\.[\d]+)?)?(?:\.min)?\.js", "certain", "jquery",
             group=1),)),
    Fingerprint("bootstrap", "Bootstrap", "javascript", (
        html(r"bootstrap[.-]?([\d]+\.[\d]+(?:\.[\d]+)?)?(?:\.min)?\.(?:js|css)", "likely",
             "bootstrap", group=1),)),
    Fingerprint("tailwind", "Tailwind CSS", "javascript", (
        html(r"tailwind(?:css)?(?:\.min)?\.css|cdn\.tailwindcss\.com", "likely", "tailwind"),)),
    Fingerprint("google_analytics", "Google Analytics", "analytics", (
        html(r"google-analytics\.com/analytics\.js|gtag/js\?id=UA-", "certain",
             "google-analytics.com/analytics.js", "gtag/js?id=ua-"),)),
    Fingerprint("google_analytics_4", "Google Analytics 4", "analytics", (
        html(r"gtag/js\?id=G-[A-Z0-9]+", "certain", "gtag/js?id=g-"),)),
    Fingerprint("google_tag_manager", "Google Tag Manager", "analytics", (
        html(r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+", "certain",
             "googletagmanager.com/gtm.js", "gtm-"),)),
    Fingerprint("meta_pixel", "Meta Pixel", "analytics", (
        html(r"connect\.facebook\.net/[^/]+/fbevents\.js", "certain", "connect.facebook.net/"),)),
    Fingerprint("hotjar", "Hotjar", "analytics", (
        html(r"static\.hotjar\.com", "certain", "static.hotjar.com"),)),
    Fingerprint("matomo", "Matomo", "analytics", (
        html(r"matomo\.js|piwik\.js", "certain", "matomo.js", "piwik.js"),)),
    Fingerprint("plausible", "Plausible", "analytics", (
        html(r"plausible\.io/js/", "certain", "plausible.io/js/"),)),
    Fingerprint("hubspot", "HubSpot", "marketing", (
        html(r"js\.hs-scripts\.com|js\.hsforms\.net", "certain",
             "js.hs-scripts.com", "js.hsforms.net"),)),
    Fingerprint("mailchimp", "Mailchimp", "marketing", (
        html(r"list-manage\.com|chimpstatic\.com", "certain",
             "list-manage.com", "chimpstatic.com"),)),
    Fingerprint("intercom", "Intercom", "marketing", (
        html(r"widget\.intercom\.io|intercomcdn\.com", "certain",
             "widget.intercom.io", "intercomcdn.com"),)),
    Fingerprint("zendesk", "Zendesk", "marketing", (
        html(r"static\.zdassets\.com|zendesk\.com/embeddable", "certain",
             "static.zdassets.com", "zendesk.com/embeddable"),)),
    Fingerprint("nginx", "Nginx", "server", (
        header("server", r"nginx(?:/([\d.]+))?", group=1),)),
    Fingerprint("apache", "Apache", "server", (
        header("server", r"Apache(?:/([\d.]+))?", group=1),)),
    Fingerprint("litespeed", "LiteSpeed", "server", (header("server", r"LiteSpeed"),)),
    Fingerprint("iis", "Microsoft IIS", "server", (
        header("server", r"Microsoft-IIS(?:/([\d.]+))?", group=1),)),
    Fingerprint("caddy", "Caddy", "server", (header("server", r"Caddy"),)),
    Fingerprint("cloudflare", "Cloudflare", "cdn", (
        header("cf-ray", r"."), header("server", r"cloudflare"))),
    Fingerprint("cloudfront", "Amazon CloudFront", "cdn", (
        header("via", r"CloudFront"), header("x-amz-cf-id", r"."))),
    Fingerprint("fastly", "Fastly", "cdn", (
        header("x-served-by", r"cache-", "likely"), header("x-fastly-request-id", r"."))),
    Fingerprint("akamai", "Akamai", "cdn", (
        header("x-akamai-transformed", r"."), header("server", r"AkamaiGHost"))),
    Fingerprint("sucuri", "Sucuri", "waf", (header("x-sucuri-id", r"."),)),
    Fingerprint("imperva", "Imperva", "waf", (
        header("x-iinfo", r"."), cookie("incap_ses"))),
    Fingerprint("vercel", "Vercel", "hosting", (header("x-vercel-id", r"."),)),
    Fingerprint("netlify", "Netlify", "hosting", (
        header("x-nf-request-id", r"."), header("server", r"Netlify"))),
    Fingerprint("github_pages", "GitHub Pages", "hosting", (
        header("server", r"GitHub\.com"),)),
    Fingerprint("aws_s3", "Amazon S3", "hosting", (header("server", r"AmazonS3"),)),
    Fingerprint("godaddy", "GoDaddy", "hosting", (header("server", r"DPS/", "likely"),)),
    Fingerprint("php", "PHP", "language", (
        header("x-powered-by", r"PHP(?:/([\d.]+))?", group=1), cookie("PHPSESSID"))),
    Fingerprint("aspnet", "ASP.NET", "framework", (
        header("x-aspnet-version", r"([\d.]+)", group=1),
        header("x-powered-by", r"ASP\.NET"))),
    Fingerprint("express", "Express", "framework", (header("x-powered-by", r"Express"),)),
    Fingerprint("laravel", "Laravel", "framework", (
        cookie("laravel_session"), cookie("XSRF-TOKEN", "possible"))),
    Fingerprint("django", "Django", "framework", (
        cookie("csrftoken", "likely"), cookie("sessionid", "possible", r"^sessionid$"))),
    Fingerprint("rails", "Ruby on Rails", "framework", (
        header("x-powered-by", r"Phusion Passenger", "likely"),
        cookie("_session_id", "possible"))),
)

# --- fixed values: latest release per technology -----------------------------------
LATEST_VERSIONS = {
    "wordpress": "6.7", "drupal": "11.1", "joomla": "5.2", "typo3": "13.4",
    "ghost": "5.101", "magento": "2.4.7", "prestashop": "8.2", "opencart": "4.0.2",
    "jquery": "3.7.1", "bootstrap": "5.3.3", "angular": "19.0.0", "react": "19.0.0",
    "vue": "3.5.13", "php": "8.4", "nginx": "1.27.3", "apache": "2.4.62", "aspnet": "9.0",
}


def failed(check_id):
    return Condition("finding_failed", check_id)


# --- opportunity rules: ids, triggers and evidence are fixed; the wording is ours ----
OPPORTUNITY_RULES = (
    OpportunityRule(
        "ssl_expired", "Certificate has lapsed", "security", "critical", (failed("TLS-03"),),
        "The certificate of ${domain} ran out ${days_expired} days ago and browsers now "
        "stop visitors before the first page.",
        "Easy to confirm in a browser; offer a same-day fix and automatic renewal.",
        ("TLS-03",), ("ssl_renewal",)),
    OpportunityRule(
        "ssl_renewal", "Certificate runs out in ${days_remaining} days", "security", "critical",
        (failed("TLS-04"),),
        "The certificate of ${domain} is valid until ${not_after}, ${days_remaining} days "
        "from the capture.",
        "State the date and offer managed renewal.", ("TLS-04",)),
    OpportunityRule(
        "no_https", "No HTTPS", "security", "critical", (failed("TLS-01"),),
        "${domain} answers over plain HTTP only, which browsers mark as not secure.",
        "The browser label is visible to the owner.", ("TLS-01",)),
    OpportunityRule(
        "email_spoofing_risk", "Mail from this domain can be forged", "security", "high",
        (failed("DNS-03"),),
        "${domain} has no DMARC record, so receivers get no instruction about forged mail.",
        "Present it as protecting the name; start with monitoring.", ("DNS-03", "DNS-01")),
    OpportunityRule(
        "dmarc_not_enforcing", "DMARC only observes", "security", "medium", (failed("DNS-04"),),
        'The DMARC policy of ${domain} is "p=${policy}": reports arrive, forged mail too.',
        "The record exists; offer to finish the rollout.", ("DNS-04",)),
    OpportunityRule(
        "spf_too_permissive", "SPF record allows every sender", "security", "high",
        (failed("DNS-02"),),
        "The SPF record of ${domain} lets servers send that nobody listed.",
        "A small change with a large effect.", ("DNS-02",)),
    OpportunityRule(
        "missing_security_headers", "Browser protections are switched off", "security", "medium",
        (failed("HDR-01"), failed("HDR-02")),
        "${domain} sends neither HSTS nor a content security policy.",
        "Configuration work whose result any header checker shows.", ("HDR-01", "HDR-02")),
    OpportunityRule(
        "login_over_http", "Admin login travels unencrypted", "security", "critical",
        (failed("CMS-03"),),
        "The admin login at ${url} is served without encryption.",
        "Report it plainly and offer to fix it.", ("CMS-03",)),
    OpportunityRule(
        "version_disclosure", "Server version is public", "security", "low",
        (failed("HDR-07"),),
        "${domain} names the exact version of its server software in every response.",
        "A supporting point within a wider hardening offer.", ("HDR-07",)),
    OpportunityRule(
        "outdated_cms", "${cms} ${detected_version} is behind", "maintenance", "high",
        (failed("CMS-02"),),
        "${domain} runs ${cms} ${detected_version}, and its page source says so.",
        "Show the version in the page source; offer a care plan.", ("CMS-02",)),
    OpportunityRule(
        "performance_no_cdn", "Slow first byte without a CDN", "performance", "medium",
        (failed("PERF-01"), failed("PERF-03")),
        "${domain} needed ${ttfb_ms} ms for the first byte and uses no delivery network.",
        "Bring a measurement the owner can repeat.", ("PERF-01",)),
    OpportunityRule(
        "not_mobile_ready", "Not laid out for phones", "development", "high",
        (failed("PERF-04"),),
        "${domain} declares no viewport, so phones show the desktop page in small.",
        "Ask the owner to open the site on a phone.", ("PERF-04",)),
    OpportunityRule(
        "mixed_content", "HTTPS move left unfinished", "security", "high", (failed("CNT-01"),),
        "Pages of ${domain} load parts over plain HTTP although the site uses HTTPS.",
        "Finish work that someone already began.", ("CNT-01",)),
    OpportunityRule(
        "no_analytics", "Nothing measures the visits", "marketing", "low",
        (Condition("artifact_falsy", analyzer="technologies", key="has_analytics"),),
        "No analytics tool was found on ${domain}.",
        "Measure first, spend later."),
    OpportunityRule(
        "cookie_consent_missing", "Tracking starts before consent", "compliance", "medium",
        (Condition("artifact_truthy", analyzer="technologies", key="has_analytics"),
         failed("PRV-02")),
        "${domain} runs tracking scripts and shows no consent banner.",
        "Keep it factual and point to their own legal advice.", ("PRV-02",)),
)


# --- packs as tables --------------------------------------------------------------------
SIGNAL_SCHEMA = (
    "tech_id string, name string, category string, signal_no int, type string, "
    "signal_name string, pattern string, version_group int, confidence string"
)


def signal_rows(fingerprints=FINGERPRINTS) -> list[tuple]:
    return [
        (f.id, f.name, f.category, n, s.type, s.name, s.pattern, s.version_group, s.confidence)
        for f in sorted(fingerprints)
        for n, s in enumerate(f.signals, start=1)
    ]


def signals_table(spark: SparkSession, fingerprints=FINGERPRINTS) -> DataFrame:
    return spark.createDataFrame(signal_rows(fingerprints), SIGNAL_SCHEMA)


def fingerprints_from_rows(rows) -> tuple[Fingerprint, ...]:
    """Rows of the signals table (already validated) back into a pack."""
    packs: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["tech_id"], r["signal_no"])):
        signal = Signal(r["type"], r["signal_name"], r["pattern"], r["version_group"],
                        r["confidence"])
        packs.setdefault(r["tech_id"], [r["name"], r["category"], []])[2].append(signal)
    return tuple(Fingerprint(i, n, c, tuple(s)) for i, (n, c, s) in packs.items())


CONDITION_SCHEMA = (
    "rule_id string, cond_no int, kind string, check_id string, analyzer string, "
    "key string, value string"
)
OPPORTUNITY_SCHEMA = (
    "rule_id string, title string, category string, urgency string, template string, "
    "pitch string"
)


def conditions_table(spark: SparkSession, rules=OPPORTUNITY_RULES) -> DataFrame:
    rows = [
        (r.id, n, *c) for r in rules for n, c in enumerate(r.requires, start=1)
    ]
    return spark.createDataFrame(rows, CONDITION_SCHEMA)


def opportunity_table(spark: SparkSession, rules=OPPORTUNITY_RULES) -> DataFrame:
    rows = [(r.id, r.title, r.category, r.urgency, r.template, r.pitch) for r in rules]
    return spark.createDataFrame(rows, OPPORTUNITY_SCHEMA)
