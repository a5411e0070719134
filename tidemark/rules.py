"""Word lists, weights, limits and texts which the results depend on."""

from __future__ import annotations

# ---- rates and bands -------------------------------------------------------------------------
MIN_RATE = 5
MAX_RATE = 95
BANDS = ((80, "SEVERE"), (55, "HIGH"), (30, "MEDIUM"))
LOWEST_BAND = "LOW"
SEVERITY_ORDER = ("SEVERE", "HIGH", "MEDIUM", "LOW")
TREND_TIME_ZONE = "Asia/Hong_Kong"

# ---- evidence weighting ----------------------------------------------------------------------
EVIDENCE_RECENT_WINDOW = 24
EVIDENCE_BACKSTOP_WINDOW = 64
EVIDENCE_KEEP = 8
DISCOVERY_PREFIX = "discovery-"
SCORING_DISCOVERY_FACTOR = 0.75
INGEST_DISCOVERY_FACTOR = 0.72
SCORING_SOURCE_FACTOR = {"official": 1.0, "jobs": 0.45, "media": 0.65}
SCORING_TYPE_FACTOR = {"ADOPTION": 1.0, "HIRING_SHIFT": 0.65, "TOOLING": 0.35}
SCORING_RELEVANCE_FACTOR = {"HIGH": 1.0, "MEDIUM": 0.8, "LOW": 0.45}
SCORING_IMPACT_FACTOR = {"INCREASE": 1.0, "DECREASE": 0.7, "MAINTAIN": 0.55}
CLASS_FACTOR = {"official": 1.0, "media": 0.8, "jobs": 0.6}
LABEL_FACTOR = {"primary": 1.0, "secondary": 0.7, "supporting": 0.45}
RELEVANCE_FACTOR = {"high": 1.0, "medium": 0.8, "low": 0.55, "none": 0.0}
SCORE_CACHE_HOURS = 6
ITEM_PROMPT_VERSION = "2026-04-16-v7"
SCORE_PROMPT_VERSION = "2026-04-16-v2"
# score caches written by these providers are reused only while fresh
SHORT_LIVED_PROVIDERS = ("minimax", "fallback")
DEFAULT_MODEL = "gemini-2.5-flash"

# ---- item to role matching -------------------------------------------------------------------
CANDIDATES_PER_ITEM = 20
FLOOR_GENERAL = 1.0
FLOOR_WORKFLOW = 0.5
FLOOR_JOB = 1.5
POINTS_MATCHED = 6.0
POINTS_TITLE = 5.0
POINTS_SUMMARY = 3.0
POINTS_HINT = 2.0
POINTS_TOKEN = 1.5
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or",
    "the", "to", "with",
)
EXCLUDED_ROLE_SLUGS = ("ai", "models")
BLOCKED_DISCOVERY_SLUGS = ("", "ai", "model", "models")
BROAD_NOISE_TERMS = (
    "funding", "fundraise", "raised", "valuation", "benchmark", "model launch", "model family",
    "ecosystem", "partnership", "policy", "regulation", "infrastructure", "infra", "gpu",
    "data center", "sponsorship", "sponsor", "brand", "community program", "award", "awards",
    "summit", "conference",
)
WORKFLOW_TERMS = (
    "workflow", "task", "tasks", "review", "triage", "reconciliation", "coding", "operations",
    "ticket", "invoice", "analysis", "release", "response", "close",
)
ROLE_ALIASES = {
    "ai": (
        "agentic workflows", "ai agents", "ai engineering", "ai engineer", "foundation model",
        "llm ops", "ml systems", "model deployment", "prompt engineering",
    ),
    "bookkeeping-clerk": (
        "accounting automation", "ai bookkeeper", "bookkeeper", "bookkeeping",
        "continuous reconciliation", "financial operations", "invoice handling", "month-end close",
        "reconciliation",
    ),
    "customer-service-representative": (
        "agentic bots", "case resolution", "contact center", "customer service", "customer support",
        "support interactions", "support ops", "support workflow", "tickets", "triage",
    ),
    "computer-and-information-research-scientists": (
        "ai architecture", "ai benchmark", "ai models", "agent architecture", "applied ai research",
        "machine learning research", "model research", "multimodal model", "rag systems",
        "research scientists",
    ),
    "computer-systems-analysts": (
        "business systems", "copilot rollout", "response operations", "secure software",
        "security response", "software workflows", "workflow redesign", "workflow integration",
        "workflow orchestration",
    ),
    "computer-occupations-all-other": (
        "copilot cli", "developer tools", "engineering workflow", "response operations",
        "secure software", "software engineering", "software tooling", "technical workflow",
    ),
    "computer-and-information-systems-managers": (
        "ai strategy", "ai transformation", "enterprise ai", "it leadership",
        "technology management",
    ),
    "data-warehousing-specialists": (
        "data engineering", "data pipelines", "data platform", "hybrid queries",
        "retrieval systems",
    ),
    "news-analysts-reporters-and-journalists": (
        "editors", "journalism", "journalists", "news organizations", "news publishers",
        "newsroom", "publishers", "reporters",
    ),
}
# lexicon of the keyword mapping decision
MAPPING_KEYWORDS = {
    "customer-service-representative": (
        "customer support", "support agent", "help desk", "contact center", "call center",
        "ticket", "triage",
    ),
    "bookkeeping-clerk": (
        "bookkeeping", "bookkeeper", "reconciliation", "invoice", "ledger", "accounting",
        "accounts payable", "accounts receivable",
    ),
    "industrial-maintenance-technician": (
        "maintenance technician", "industrial maintenance", "equipment repair",
        "plant maintenance", "field service", "preventive maintenance", "machine servicing",
    ),
}

# ---- role profile ----------------------------------------------------------------------------
PROFILE_BASE = 34
PROFILE_MIN = 8
PROFILE_MAX = 88
REPEATED_TEXT_TERMS = (
    "customer support", "customer service", "ticket", "triage", "bookkeeping", "accounting",
    "reconciliation", "invoice", "data entry", "technical writer", "editing", "editor",
    "journalist", "reporter", "claims", "clerks", "billing", "administrative", "research analyst",
    "marketing",
)
SOFTWARE_TERMS = ("software", "developer", "programming", "coding", "code", "systems analyst")
PHYSICAL_TERMS = (
    "maintenance", "technician", "repair", "industrial", "mechanic", "construction", "field",
    "healthcare", "nurse", "surgeon",
)
JUDGMENT_TERMS = (
    "manager", "negotiation", "lawyer", "compliance", "public relations", "sales managers",
    "human resources",
)
PROFILE_SUMMARY = {
    "tracked_en": (
        "This role is being tracked with ", " recent source signal",
        " and a profile-based replacement estimate.",
    ),
    "tracked_zh": ("这个岗位当前结合了 ", " 条近期来源信号和岗位画像推理来给出替代率。"),
    "none_en": (
        "No role-specific source items are attached yet, so the current score is inferred from the "
        "role profile and current AI capability trends."
    ),
    "none_zh": "这个岗位暂时还没有挂接到足够的专属资讯，因此当前分数主要由岗位性质和当前 AI 能力趋势推理得出。",
}
REASON_TITLES = {
    "profile": ("Role-profile inference", "岗位画像推理"),
    "constraints": ("Human and physical constraints", "人类判断与物理约束"),
    "no_source": ("No role-specific sources yet", "尚无岗位专属来源"),
}
REASON_DETAILS = {
    "software": (
        "The role is tightly coupled to digital production workflows where AI coding and "
        "automation tools are advancing quickly.",
        "这个岗位高度依赖数字化生产流程，而 AI 编码与自动化工具的进展非常快。",
    ),
    "repeated": (
        "The role contains repeatable, language-heavy, or rules-based workflows that AI systems "
        "can increasingly compress.",
        "这个岗位包含较多可重复、语言密集或规则清晰的工作流，越来越容易被 AI 压缩。",
    ),
    "neither": (
        "The role profile includes some repeatable digital work, but not enough to imply "
        "immediate large-scale replacement.",
        "这个岗位虽然包含部分可数字化工作，但还不足以推导出短期内大规模替代。",
    ),
    "physical": (
        "Physical execution and field variability materially reduce near-term substitution "
        "pressure.",
        "物理执行和现场变化显著降低了这个岗位的短期 AI 替代压力。",
    ),
    "judgment": (
        "Human judgment, negotiation, or people management still slows full AI substitution.",
        "人类判断、协商和管理成分仍然会拖慢这个岗位被完全替代。",
    ),
    "exposed": (
        "The role remains exposed where the work is mostly digital and structured, with fewer "
        "physical barriers.",
        "当工作大多是数字化、结构化流程时，这个岗位的暴露度会更高。",
    ),
    "no_source": (
        "This percentage is currently anchored by role nature rather than attached role-specific "
        "news items.",
        "当前百分比主要锚定岗位性质，而不是已挂接的岗位专属新闻资讯。",
    ),
}

# ---- presentation ----------------------------------------------------------------------------
BAND_PERCENTAGE = {"LOW": 18, "MEDIUM": 43, "HIGH": 68, "SEVERE": 86}
BAND_SUMMARY = {
    "en": {
        "LOW": "Most of the work still depends on physical execution, ambiguity, or human handoffs.",
        "MEDIUM": "Structured recurring tasks are increasingly compressible, but the whole role is "
                  "not yet AI-first.",
        "HIGH": "Core workflows are already being re-routed through AI systems in production "
                "settings.",
        "SEVERE": "A large share of the role can now be absorbed by AI-led workflows with minimal "
                  "human lift.",
    },
    "zh": {
        "LOW": "这个岗位的大部分工作仍受物理执行、情境判断或人工交接保护。",
        "MEDIUM": "结构化的重复任务正在被压缩，但整个岗位还没有进入 AI 优先阶段。",
        "HIGH": "核心工作流已经在真实业务中被重新导向到 AI 系统。",
        "SEVERE": "这个岗位中相当大一部分工作已经可以被 AI 主导流程吸收，只需极少人工介入。",
    },
}
PENDING_LABEL = {"en": "Signal pending", "zh": "信号待补"}
PENDING_SUMMARY = {
    "en": "Confirmed signal volume is still too thin for a reliable AI replacement rate, so the "
          "page only shows known movement.",
    "zh": "当前确认信号还不足以给出可信的 AI 替代率，页面只展示已知动态。",
}
PLACEHOLDER_SUMMARIES = (
    "No role-specific source items are attached yet",
    "This role is being tracked with 0 recent source signal",
    "这个岗位暂时还没有挂接到足够的专属资讯",
    "这个岗位当前结合了 0 条近期来源信号",
)
TIMELINE_SUMMARY = {
    "en": ("This role is currently tracked with ", " timeline item",
           " plus a profile-based replacement estimate."),
    "zh": ("这个岗位当前已结合 ", " 条时间线资讯和岗位画像推理来给出替代率。"),
}

# ---- catalogue -------------------------------------------------------------------------------
HOME_WORKING_SET = 760
RANKING_SIZE = 10
PRIORITY_SLUGS = (
    "actors", "customer-service-representative", "project-management-specialists",
    "management-analysts", "human-resources-specialists", "human-resources-managers",
    "financial-managers", "marketing-managers", "sales-managers",
    "business-intelligence-analysts", "computer-systems-analysts",
    "administrative-services-managers", "billing-and-posting-clerks",
    "bill-and-account-collectors", "claims-adjusters-examiners-and-investigators",
    "compliance-officers", "operations-research-analysts", "public-relations-specialists",
    "public-relations-managers", "technical-writers", "training-and-development-specialists",
    "market-research-analysts-and-marketing-specialists", "editors", "data-entry-keyers",
    "database-architects", "desktop-publishers", "purchasing-managers",
    "receptionists-and-information-clerks", "lawyers",
    "legal-secretaries-and-administrative-assistants",
)
TERM_ALIASES = {
    "finance": ("financial",),
    "financial": ("finance",),
    "lawyer": ("lawyers", "legal"),
    "lawyers": ("lawyer", "legal"),
    "attorney": ("attorneys", "legal"),
    "attorneys": ("attorney", "legal"),
    "legal": ("lawyer", "lawyers", "attorney", "attorneys"),
}
# topic slug -> (keywords or None, minimum rate or None, limit)
TOPICS = {
    "highest-ai-replacement-rates": (None, 55, 20),
    "which-jobs-are-most-at-risk": (None, 45, 20),
    "administrative-and-office-jobs": (
        ("administrative", "office", "clerical", "assistant", "scheduling"), None, 24),
    "customer-support-jobs": (
        ("customer support", "call center", "service representative", "help desk",
         "customer success"), None, 24),
    "finance-and-accounting-jobs": (
        ("accounting", "bookkeeping", "payroll", "billing", "finance", "financial"), None, 24),
    "legal-jobs": (
        ("legal", "paralegal", "attorney", "lawyer", "lawyers", "contracts", "compliance"),
        None, 24),
}
FEATURED_TOPICS = (
    "highest-ai-replacement-rates", "which-jobs-are-most-at-risk",
    "administrative-and-office-jobs",
)
# english name -> (slug, occupation code, keywords)
DICTIONARY_OVERRIDES = {
    "Customer Service Representatives": (
        "customer-service-representative", "43-4051",
        ("customer support", "support agent", "help desk", "call center", "ticket triage")),
    "Executive Secretaries and Executive Administrative Assistants": (
        "executive-secretary-and-administrative-assistant", "43-6011", None),
    "Legal Secretaries and Administrative Assistants": (
        "legal-secretary-and-administrative-assistant", "43-6012", None),
    "Market Research Analysts and Marketing Specialists": (
        "market-research-analyst", "13-1161",
        ("market research", "consumer insights", "survey analysis", "reporting")),
}
# source code, occupation code, slug, english name, chinese name, keywords
PRESERVED_ROLES = (
    ("43-3031", "43-3031", "bookkeeping-clerk", "Bookkeeping Clerk", "记账员",
     ("bookkeeping", "reconciliation", "ledger", "accounts payable", "invoice")),
    ("49-9041", "49-9041", "industrial-maintenance-technician",
     "Industrial Maintenance Technician", "工业维护技师",
     ("maintenance technician", "equipment repair", "preventive maintenance", "field service")),
)
DICTIONARY_GROUP = "all-roles"

# ---- discovery -------------------------------------------------------------------------------
AI_TERMS = (
    "ai", "artificial intelligence", "automation", "automate", "agent", "agents", "copilot", "llm",
)
DISCOVERY_WORKFLOW_TERMS = (
    "workflow", "workflows", "task", "tasks", "ticket", "tickets", "triage", "routing", "case",
    "cases", "resolution", "review", "response", "operations", "process", "job",
)
DISCOVERY_NOISE_TERMS = (
    "funding", "raises", "raised", "valuation", "investor", "investors", "series a", "series b",
    "seed round", "conference", "summit", "webinar", "event", "award",
)
LANDING_PATHS = ("", "/", "/blog", "/blog/")
ARTICLE_SEGMENTS = (
    "article", "articles", "blog", "insights", "news", "press", "resource", "resources",
    "stories", "update", "updates",
)
REFERENCE_HOSTS = ("bls.gov", "onetonline.org", "careeronestop.org")
VERTICAL_SEGMENTS = ("industry", "industries")
MARKETING_TITLE_TERMS = (
    "#1", "software", "platform", "powered", "for small businesses", "blog & resources",
    "chatbot", "chatbots",
)
EVERGREEN_TITLE_TERMS = (
    "will ", "future of", "what does ai mean", "not obsolete", "more valuable",
)
REFERENCE_TITLE_TERMS = (
    "occupational outlook handbook", "tasks automated by ai", "bureau of labor statistics",
    "job profile", "career profile",
)
QUERIES_BUILT = 8
QUERIES_RUN = 3
TIMELINE_SIZE = 10
ADJUDICATIONS = 3
TASK_KEYWORDS = 4

# ---- extraction ------------------------------------------------------------------------------
FEED_ITEMS = 6
JOB_ITEMS = 8
CARD_CLASS_HINTS = ("post-card", "entry-card", "article-card", "post-item")
PROMO_TERMS = (
    "sponsored", "promoted", "promotional", "advertorial", "advertisement", "newsletter",
    "webinar", "promo",
)
# pattern, weight
LISTING_RANK_RULES = (
    (r"\bfoundry\b|\bmai models?\b|\bmodel(s)?\b", 7),
    (r"\bcopilot\b|\bmicrosoft 365 copilot\b", 6),
    (r"\bdevelopers?\b|\bdeveloper\b", 6),
    (r"\bagents?\b|\bagentic\b", 5),
    (r"\bworkflow(s)?\b|\bwork\b", 5),
    (r"\bsecure software\b|\bsoftware\b|\bengineering\b", 4),
    (r"\bproductivity\b|\bc suite\b|\bpartnerships?\b", 3),
    (r"\bresponse operations\b|\bmsrc\b|\bsecurity response\b", 3),
    (r"\bhealthcare\b|\bwellbeing\b", -5),
    (r"\blanguage\b|\beveryone\b", -4),
)

# ---- notifications and limits ----------------------------------------------------------------
DIGEST_INTERVAL_DAYS = 7
SIGNIFICANT_DELTA = 8
WATCH_LIMIT = 3
THROTTLE_WINDOW_S = 15 * 60
THROTTLE_MAX = 10
THROTTLE_BLOCK_S = 30 * 60
COOLDOWN_S = 60
REQUEST_WINDOW_S = 60 * 60
REQUEST_MAX = 5
CODE_TTL_S = 10 * 60
FAILURES_MAX = 5
LOCK_S = 15 * 60

# ---- messages written into rows --------------------------------------------------------------
MISSING_ZH_SUMMARY = "该信号尚未提供中文摘要。"
CLASSIFY_TEXTS = {
    "no_candidate": (
        "No role candidate matched the source title and summary strongly enough, so the item stays "
        "unmatched.",
        "The source item is too broad or indirect to attach to one occupation with high precision.",
    ),
    "outside": (
        "The model returned a role slug outside the allowed candidate set (",
        "), so the item was kept unmatched.",
        "The source item could not be attached to one of the allowed occupation candidates with "
        "enough confidence.",
    ),
    "error": (
        "Classification fallback used because the model was unavailable or returned an error: ",
        "The source was fetched successfully, but model classification was temporarily "
        "unavailable, so the item was handled with a broader fallback.",
        "来源已抓取成功，但模型分类暂时不可用，因此该条目使用了更宽松的回退处理。",
    ),
    "promoted": (
        " The item was attached to the closest matching role candidate (",
        ") because broader, adjacent-role linkage is allowed when keyword overlap is concrete.",
    ),
    "error_promoted": (
        "The source was attached to the closest matching role candidate while the model was "
        "unavailable, so it can still appear in the role timeline.",
        "由于模型暂时不可用，该来源被挂到最接近的岗位上，以便先出现在岗位时间线中。",
    ),
}
