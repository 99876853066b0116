"""Fixed values the results depend on: word lists, pattern lists, lookup tables."""

# Stop words per task.
STOP_AUDIT = (
    "the a an is are was were be been and or not in on at to for of with by from this that it as "
    "if but so than là và của cho với trong khi để từ các một có được không này đó về theo như "
    "cũng hoặc nếu thì hay do vì bởi"
).split()
STOP_EXTRACT = (
    "the a an is are was were be been and or not in on at to for of with by this that it as if but "
    "so than from là và của cho với trong khi để từ các một có được không này đó về theo"
).split()
STOP_DEDUP = STOP_EXTRACT + "như cũng hoặc nếu thì hay do vì bởi".split()
STOP_VERIFY = (
    "là và của các có được cho trong với này một để không khi từ như về theo the and for that this "
    "with from are was have has been will can not but use you"
).split()
STOP_PARSER = (
    "là và của các có được cho trong với này một để không khi thì từ đã sẽ như nhưng cũng về theo "
    "the a an and or is in to for of with on at by this that it be as are was were been has have"
).split()
GENERIC_BASELINE = (
    "the and for this with that from your các của cho với trong được không một"
).split()
GENERIC_TOPIC = "the and for with this that from các của cho với trong được không".split()

# Negations, matched as substrings.
NEGATIONS = (
    "not", "no", "never", "none", "without", "cannot", "can't", "don't", "doesn't", "isn't",
    "aren't", "won't", "shouldn't", "không", "chưa", "chẳng", "không có", "không nên",
    "không thể", "đừng", "hết", "thiếu",
)

# Baseline summaries are admitted only from these sources.
BASELINE_SOURCES = ("skill_seekers", "auto-discovery", "auto-discovery-content")

# URL substrings that mark a page as no documentation, per stage.
EXCLUDE_DISCOVERY = (
    "/login", "/signup", "/register", "/cart", "/checkout", "/search?", "/tag/", "#comment",
    "/privacy", "/terms", "/cookie", "accounts.google", "facebook.com/login", ".pdf", ".zip",
    ".exe", "youtube.com", "twitter.com",
)
EXCLUDE_EVALUATION = (
    "/login", "/signup", "/register", "/cart", "/checkout", "/search?q=", "#comment",
    "/privacy-policy", "/terms-of-service", "/cookie", "accounts.google.com", "facebook.com/login",
    "youtube.com/watch", "twitter.com/", "x.com/", ".pdf", ".zip", ".exe", ".dmg", ".pkg",
    "/wp-admin", "/wp-login", "/feed/", "/rss",
)
EXCLUDE_CONTENT = (
    "/login", "/signup", "/register", "/cart", "/checkout", "/search?", "#comment", "/privacy",
    "/terms", "accounts.google", "facebook.com/login", ".zip", ".exe", "youtube.com/watch",
)
# Hosts rendered by script only.
SCRIPTED_HOSTS = (
    "docs.anthropic.com", "platform.openai.com", "cloud.google.com", "console.cloud.google.com",
    "console.firebase.google.com", "console.aws.amazon.com", "portal.azure.com", "notion.so",
    "app.notion.so", "airtable.com", "figma.com", "miro.com", "trello.com",
    "dashboard.stripe.com", "app.hubspot.com", "app.asana.com", "linear.app",
)

# File classification of a source tree.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache",
    "vendor", "target", ".idea", ".vscode", "coverage", ".tox", "egg-info", ".mypy_cache",
    ".pytest_cache", ".ruff_cache",
)
IGNORED_FILES = (
    ".gitignore", ".dockerignore", "package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock",
    "pnpm-lock.yaml",
)
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "react",
    ".tsx": "react-typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".c": "c",
    ".sh": "shell", ".sql": "sql",
}
DOC_SUFFIXES = (".md", ".rst", ".txt", ".adoc")
CONFIG_FILES = (
    "package.json", "setup.py", "pyproject.toml", "Cargo.toml", "Makefile", "Dockerfile",
    "docker-compose.yml", "tsconfig.json", ".env.example", "requirements.txt", "go.mod", "Gemfile",
)
ENTRY_POINTS = (
    "main.py", "app.py", "cli.py", "index.ts", "index.js", "server.py", "server.ts", "manage.py",
    "__main__.py", "src/index.ts", "src/main.ts", "src/app.ts", "src/index.js", "src/main.js",
    "src/app.js",
)

# Category taxonomies per domain.
DOMAIN_ALIASES = {
    "facebook-ads": "fb_ads", "facebook_ads": "fb_ads", "fb-ads": "fb_ads", "meta-ads": "fb_ads",
    "google-ads": "google_ads", "googleads": "google_ads",
}
TAXONOMY = {
    "fb_ads": {
        "campaign_management": "campaign_creation campaign_types objectives campaign_budget",
        "audience_targeting": "custom_audience lookalike interest_targeting retargeting",
        "ad_creative": "ad_formats copywriting images_video cta",
        "pixel_tracking": "pixel_setup events conversions attribution",
        "optimization": "ab_testing scaling budget_optimization performance",
        "policy_compliance": "ad_policies account_health review_process restricted",
    },
    "google_ads": {
        "search_ads": "keywords match_types quality_score",
        "display_ads": "placements audiences creative",
        "shopping": "feed merchant_center campaigns",
        "bidding": "smart_bidding manual target_roas",
        "analytics": "conversion ga4 attribution",
        "optimization": "testing scripts automation",
    },
    "custom": {
        "fundamentals": "concepts terminology principles",
        "procedures": "workflows steps best_practices",
        "tools": "setup configuration integration",
        "strategy": "planning analysis decision_making",
        "advanced": "optimization troubleshooting edge_cases",
        "compliance": "regulations guidelines safety",
    },
}
GENERIC_DOMAINS = ("custom", "unknown", "general", "other", "misc", "test", "default")
PATTERN_TYPES = (
    "architecture", "function", "configuration", "error_handling", "integration", "best_practice",
    "general",
)

# Weights, bands and prices of the scorecards.
PHASE_WEIGHTS = {"p0": 0.15, "p1": 0.10, "p2": 0.25, "p3": 0.15, "p4": 0.20, "p5": 0.15}
TIER_WEIGHTS = {"basic": 0.30, "applied": 0.40, "advanced": 0.30}
SAMPLE_PERCENT = {"draft": 30, "standard": 70, "premium": 100}
# Dollars per million tokens, (input, output); any other model costs the default.
MODEL_PRICES = {
    "claude-sonnet-4-5-20250929": (3.0, 15.0), "claude-sonnet-4-20250514": (3.0, 15.0),
    "claude-haiku-4-5-20251001": (0.80, 4.0), "deepseek-chat": (0.14, 0.28),
    "claude-opus-4-6": (15.0, 75.0),
}
DEFAULT_PRICE = (3.0, 15.0)

# What a grade says about a build.
VERDICTS = {
    "A": "Production-ready",
    "B": "Usable — minor improvements possible",
    "C": "Usable with caveats — consider rebuilding",
    "D": "Below standard — rebuild recommended",
    "F": "Not usable — needs significant rework",
}
