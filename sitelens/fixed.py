"""Fixed values.

Everything here must hold exactly these values for the results to be right:
enumerations with their ranks and weights, word lists, thresholds and patterns.
They are plain data; users may pass their own in place of any of them.
"""

# --- enumerations: value -> rank / weight ---------------------------------
SEVERITIES = ("critical", "high", "medium", "low", "info")
STATUSES = ("fail", "warn", "pass", "info", "not_applicable")
PROBLEM_STATUSES = ("fail", "warn")
CONFIDENCE_WEIGHT = {"certain": 1.0, "likely": 0.7, "possible": 0.4}
URGENCY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
URGENCY_WEIGHT = {"critical": 30.0, "high": 20.0, "medium": 10.0, "low": 4.0}
OPPORTUNITY_CATEGORIES = (
    "security", "performance", "maintenance", "development", "marketing",
    "hosting", "compliance",
)
TECH_CATEGORIES = (
    "cms", "ecommerce", "framework", "javascript", "language", "server",
    "hosting", "cdn", "waf", "analytics", "marketing", "database_hint",
)
CONTACT_KINDS = ("email", "phone", "address", "social", "form")
SIGNAL_TYPES = ("header", "html", "cookie", "meta_generator", "script_src", "url")
CONDITION_KINDS = (
    "finding_failed", "finding_passed", "finding_absent",
    "artifact_truthy", "artifact_falsy", "artifact_equals",
)

# --- thresholds -------------------------------------------------------------
SLOW_TTFB_MS = 1500
CERT_EXPIRY_WARN_DAYS = 30
CERT_CRITICAL_DAYS = 7
LARGE_PAGE_BYTES = 3 * 1024 * 1024
MAX_PAGES_PER_SITE = 8

# --- patterns over page source ------------------------------------------------
GENERATOR_PATTERN = (
    r"""(?i)<meta[^>]+name\s*=\s*["']generator["'][^>]+content\s*=\s*["']([^"']+)["']"""
)
VIEWPORT_PATTERN = r"""(?i)<meta[^>]+name\s*=\s*["']viewport["']"""
MIXED_CONTENT_PATTERN = (
    r"""(?i)(?:src|href)\s*=\s*["']http://(?!localhost|127\.0\.0\.1)"""
)
VERSION_IN_BANNER = r"\d+\.\d+"
PRIVACY_PATTERN = r"(?i)(privacy[-\s]?policy|privacy[-_]?notice|/privacy)"
CONSENT_PATTERN = (
    r"(?i)(cookie[-\s]?(consent|banner|notice|policy)|cookieconsent|gdpr|"
    r"onetrust|cookiebot|termly|iubenda|klaro|didomi)"
)
DMARC_POLICY_PATTERN = r"(?i)\bp\s*=\s*(none|quarantine|reject)\b"
SPF_ALL_PATTERN = r"(?i)([+\-~?])all\b"
VERSION_PATTERN = r"^[vV]?(\d+(?:\.\d+)*)(?:[-+._]?(.*))?$"
NUMBER_PATTERN = r"\d+(?:[.,]\d+)*"
# the same matches in time linear in the text: a run of name signs is entered once and not given back
EMAIL_SCAN_PATTERN = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ASSET_NAME_PATTERN = r"\.(png|jpe?g|gif|svg|webp|css|js|woff2?)$"
PERSONAL_LOCAL_PATTERN = r"^[a-z]{1,20}[._\-][a-z]{2,20}$"
SOCIAL_PATTERNS = (
    ("linkedin", r"(?i)linkedin\.com/(?:company|in)/[\p{L}\p{N}_\-.%]+"),
    ("facebook", r"(?i)facebook\.com/[\p{L}\p{N}_\-.%]+"),
    ("twitter", r"(?i)(?:twitter\.com|x\.com)/[\p{L}\p{N}_\-.%]+"),
    ("instagram", r"(?i)instagram\.com/[\p{L}\p{N}_\-.%]+"),
    ("youtube", r"(?i)youtube\.com/(?:c|channel|user|@)[\p{L}\p{N}_\-.%/]+"),
)
SOCIAL_NOISE_PATTERN = (
    r"(?i)/(?:sharer|share|intent|dialog|plugins|tr\?|home\?|login|privacy|policies)"
)

# --- word lists -----------------------------------------------------------------
PARKED_MARKERS = (
    "this domain is for sale", "buy this domain", "domain parking",
    "parked free", "godaddy.com/domainsearch", "sedoparking.com",
)
LINK_HINTS = ("contact", "kontakt", "about", "impressum", "imprint", "privacy", "legal")
CANDIDATE_PATHS = (
    ("/contact", "contact"), ("/contact-us", "contact"), ("/contactus", "contact"),
    ("/about", "about"), ("/about-us", "about"),
    ("/privacy", "privacy"), ("/privacy-policy", "privacy"),
    ("/imprint", "legal"), ("/legal", "legal"),
)
SKIPPED_HREFS = ("mailto:", "tel:", "javascript:", "#", "data:")
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "domain.com", "yourdomain.com",
    "yourcompany.com", "email.com", "test.com", "sentry.io", "wixpress.com",
    "godaddy.com", "squarespace.com", "w3.org", "schema.org", "sentry-cdn.com",
    "googleapis.com", "gstatic.com", "cloudflare.com", "jquery.com",
)
FREEMAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com",
    "live.com", "aol.com", "icloud.com", "me.com", "protonmail.com", "gmx.com",
    "mail.com", "yandex.com", "zoho.com",
)
ROLE_CATEGORIES = {
    "info": "general", "hello": "general", "contact": "general", "enquiries": "general",
    "inquiries": "general", "office": "general", "admin": "general", "mail": "general",
    "sales": "sales", "business": "sales", "partnerships": "sales", "support": "support",
    "help": "support", "service": "support", "helpdesk": "support", "careers": "careers",
    "jobs": "careers", "hr": "careers", "recruitment": "careers", "security": "security",
    "abuse": "security", "privacy": "security", "billing": "billing", "accounts": "billing",
    "invoices": "billing",
}
CATEGORY_RANK = {
    "general": 10, "sales": 20, "support": 30, "billing": 50, "security": 60,
    "careers": 70, "other": 90,
}
CSV_DOMAIN_HEADERS = ("domain", "website", "url", "site", "web", "website url", "web address")
CSV_NAME_HEADERS = ("name", "company", "business", "business name", "company name", "title")
CSV_CITY_HEADERS = ("city", "town", "locality")
CSV_COUNTRY_HEADERS = ("country", "country_code", "cc")
CSV_DELIMITERS = (",", ";", "\t", "|")

# --- admin pages by CMS ------------------------------------------------------------
ADMIN_PATHS = {
    "wordpress": "/wp-login.php", "drupal": "/user/login",
    "joomla": "/administrator", "magento": "/admin",
}

# --- headers -----------------------------------------------------------------------
HEADER_CHECKS = (
    ("HDR-01", "strict-transport-security", "high"),
    ("HDR-02", "content-security-policy", "high"),
    ("HDR-03", "x-content-type-options", "medium"),
    ("HDR-05", "referrer-policy", "low"),
    ("HDR-06", "permissions-policy", "low"),
)
SECURITY_HEADERS = (
    "strict-transport-security", "content-security-policy", "x-content-type-options",
    "x-frame-options", "referrer-policy", "permissions-policy",
)
BANNER_HEADERS = ("server", "x-powered-by", "x-aspnet-version", "x-generator")
DKIM_SELECTORS = ("default", "google", "k1", "selector1", "selector2")

# --- scoring -----------------------------------------------------------------------
SECURITY_GROUPS = (
    ("tls", 35.0, ("TLS-01", "TLS-02", "TLS-03", "TLS-04", "TLS-05", "TLS-06", "TLS-08")),
    ("headers", 25.0, ("HDR-01", "HDR-02", "HDR-03", "HDR-04", "HDR-05", "HDR-06")),
    ("email_auth", 25.0, ("DNS-01", "DNS-02", "DNS-03", "DNS-04")),
    ("disclosure", 15.0, ("HDR-07", "CNT-01", "CNT-02", "CKY-01", "CKY-02")),
)
WEBSITE_CHECKS = ("PERF-01", "PERF-02", "PERF-03", "PERF-04", "TLS-01", "CMS-02")

# --- addresses that are never fetched: CIDR blocks -------------------------------------
BLOCKED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)
BLOCKED_IPV6 = ("::1/128", "fc00::/7", "fe80::/10", "ff00::/8")
ALLOWED_PORTS = (80, 443)

# --- flat export -----------------------------------------------------------------------
EXPORT_COLUMNS = (
    "business_name", "website", "domain", "city", "country", "status",
    "primary_email", "all_emails", "phone", "address", "linkedin", "facebook",
    "twitter", "instagram", "contact_form_url", "cms", "cms_version",
    "cms_outdated", "server", "cdn", "analytics", "technologies", "has_ssl",
    "ssl_expires_at", "ssl_days_remaining", "tls_version", "has_hsts", "has_csp",
    "has_spf", "has_dmarc", "dmarc_policy", "missing_headers_count",
    "critical_findings", "high_findings", "lead_score", "website_score",
    "security_score", "opportunity_score", "opportunity_count",
    "top_opportunity", "opportunities", "scanned_at",
)
FORMULA_PREFIX_PATTERN = "^[=+\\-@\t\r]"

# --- telephone dial plan: calling code -> (min, max national digits, trunk prefix) ----
# A lookup in place of a numbering-plan library; pass another to extend it.
DIAL_PLAN = {
    "1": (10, 10, ""), "7": (10, 10, ""), "20": (8, 10, "0"), "27": (9, 9, "0"),
    "30": (10, 10, ""), "31": (9, 9, "0"), "32": (8, 9, "0"), "33": (9, 9, "0"),
    "34": (9, 9, ""), "36": (8, 9, ""), "39": (6, 11, ""), "40": (9, 9, "0"),
    "41": (9, 9, "0"), "43": (7, 13, "0"), "44": (9, 10, "0"), "45": (8, 8, ""),
    "46": (7, 9, "0"), "47": (8, 8, ""), "48": (9, 9, ""), "49": (7, 12, "0"),
    "51": (8, 9, "0"), "52": (10, 10, ""), "54": (10, 11, "0"), "55": (10, 11, "0"),
    "56": (9, 9, ""), "57": (8, 10, ""), "60": (8, 10, "0"), "61": (9, 9, "0"),
    "62": (8, 12, "0"), "63": (8, 10, "0"), "64": (8, 10, "0"), "65": (8, 8, ""),
    "66": (8, 9, "0"), "81": (9, 10, "0"), "82": (8, 10, "0"), "84": (9, 10, "0"),
    "86": (9, 11, "0"), "90": (10, 10, "0"), "91": (10, 10, "0"), "92": (9, 10, "0"),
    "351": (9, 9, ""), "352": (6, 9, ""), "353": (8, 9, "0"), "358": (6, 10, "0"),
    "380": (9, 9, "0"), "420": (9, 9, ""), "852": (8, 8, ""), "966": (8, 9, "0"),
    "971": (8, 9, "0"), "972": (8, 9, "0"),
}
