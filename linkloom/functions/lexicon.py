"""Word lists, labels and thresholds. Results depend on them."""

from __future__ import annotations

# fmt: off
DEFAULT_CATEGORY = "待整理"
DISCOVERY_ROOT = "发现主题"
REVIEW_ROOT = "待审阅"
MAIN_GROUP = "主要主题"
BUCKET_NAMES = {"fetch_blocked": "信息不足", "rule_gap": "候选主题", "low_confidence": "主题不明确"}
REASON_LABELS = {
    "ok": "可访问", "timeout": "访问超时", "dns_connection": "DNS/连接失败", "certificate": "证书异常", "access_denied": "访问受限/疑似反爬",
    "rate_limited": "访问受限/频率限制", "not_found": "链接不存在", "server_error": "站点服务异常", "http_error": "HTTP 4xx/5xx",
    "invalid_url": "无效链接/非HTTP", "other_error": "其他抓取异常", "trusted_access": "受信任站点/疑似反爬",
}
ACTION_LABELS = {"not_found": "可能已失效", "invalid_url": "地址格式异常", "certificate": "安全证书异常", "http_error": "访问状态异常"}
ACTION_FALLBACK = "链接需要复查"
CERTIFICATE_MARKERS = (
    "certificate verify failed", "sslcertverificationerror", "hostname mismatch", "certificate has expired", "tlsv1_alert", "tlsv1 alert internal error",
)
NETWORK_MARKERS = (
    "nodename nor servname provided", "name or service not known", "temporary failure in name resolution", "getaddrinfo failed",
    "cannot connect to host", "connect call failed", "connection reset by peer", "network is unreachable",
)
GENERIC_PLATFORM_DOMAINS = (
    "github.com", "github.io", "gitlab.com", "gitee.com", "bitbucket.org", "stackoverflow.com", "stackexchange.com", "medium.com", "zhihu.com",
    "csdn.net", "51cto.com", "jianshu.com", "cnblogs.com", "docs.qq.com", "qq.com", "tencent.com", "docs.google.com", "google.com", "notion.so",
    "youtube.com", "bilibili.com", "feishu.cn", "feishu.com", "larksuite.com",
)
GENERIC_PLATFORM_TOKENS = (
    "github", "gitlab", "gitee", "bitbucket", "stackoverflow", "stack", "overflow", "medium", "zhihu", "zhuanlan", "csdn", "51cto", "jianshu", "qq",
    "tencent", "google", "notion", "youtube", "bilibili", "repository", "repositories", "repo", "code", "search", "users", "issues", "pull", "requests",
    "source", "master", "main", "branch", "branches", "commit", "commits", "stars", "forks", "watch", "actions", "projects", "insights", "releases",
    "details", "article", "weixin", "feishu", "larksuite",
)
NOISY_TOKENS = (
    "about", "also", "article", "articles", "blog", "blogs", "book", "books", "chapter", "code", "community", "details", "developers", "documentation",
    "download", "downloads", "feedback", "gitcode", "guide", "home", "homepage", "homepages", "index", "latest", "management", "official", "overview",
    "page", "pages", "please", "post", "posts", "provide", "reference", "repo", "repository", "research", "saved", "search", "searches", "source",
    "standard", "standards", "stable", "tool", "tools", "tutorial", "user", "webpage", "wiki", "question", "questions", "breadcrumblist", "indexhtml",
    "githubio", "飞书", "官方文档", "官方网站", "文档中心", "社区", "在线文档",
)
WEAK_TOKENS = (
    "ai", "api", "client", "create", "data", "database", "display", "distributed", "efficient", "example", "examples", "fast", "language", "management",
    "method", "native", "phone", "programming", "server", "storage", "system", "systems", "website", "welcome", "week",
)
SOURCE_LIKE_TOKENS = (
    "official", "documentation", "docs", "doc", "guide", "manual", "reference", "intro", "introduction", "community", "wiki", "blog", "blogs", "article",
    "articles", "repository", "repositories", "repo", "book", "books", "bookstack", "page", "pages", "home", "index", "stable", "latest", "action",
    "awesome", "ahead", "research", "session", "sessions", "chapter", "part", "html", "pdf", "online", "website", "excel", "word", "ppt", "slide",
    "slides", "sheet", "performance", "developers", "developer", "segmentfault", "v2ex", "amazonaws", "personal", "service", "services", "just", "news",
    "center", "官方网站", "在线文档", "腾讯文档", "腾讯云", "云启未来", "文档中心", "官方文档", "开发者", "社区", "技术团队", "稳定版", "githubio",
)
TOPIC_STOPWORDS = (
    "www", "com", "cn", "org", "net", "io", "co", "dev", "docs", "doc", "blog", "blogs", "www2", "the", "and", "for", "with", "from", "into", "your",
    "that", "this", "guide", "tutorial", "learn", "official", "reference", "documentation", "intro", "about", "index", "article", "posts", "post",
    "home", "product", "tool", "tools", "general", "read", "free", "download", "downloads", "file", "files",
    "的", "了", "和", "是", "在", "用", "教程", "指南", "文档", "文章", "首页", "官网", "页面",
)
CLUSTER_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "this",
    "that", "how", "what", "why", "www", "http", "https", "com", "org", "net", "io", "cn", "blog", "docs", "doc", "home", "page", "index", "guide",
    "tutorial", "official", "的", "了", "和", "是", "在", "有", "个", "我", "他", "她", "它", "教程", "指南", "官网", "文档", "文章", "页面",
)
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.cn", "com.au", "com.hk", "co.jp", "com.br")
GENERIC_TITLES = ("home", "index", "welcome", "untitled", "首页", "主页", "documentation", "docs", "untitled page")
PAGE_TYPES = {
    "documentation": ("docs", "documentation", "manual", "reference", "api", "guide", "sdk"),
    "blog": ("article", "post", "blog", "news", "archive"),
    "product": ("pricing", "features", "about", "solutions", "customers", "contact"),
    "tool": ("dashboard", "app", "tool", "editor", "workspace", "console"),
    "repository": ("github", "gitlab", "bitbucket", "repo", "repository", "issues", "pull"),
    "research": ("paper", "research", "publication", "arxiv", "doi", "abstract"),
}
PAGE_TYPE_FACETS = {"documentation": "文档", "blog": "博客", "product": "产品", "tool": "工具", "repository": "仓库", "research": "论文"}
SCHEMA_TYPE_FACETS = {
    "article": "博客", "blogposting": "博客", "techarticle": "博客", "newsarticle": "博客", "creativework": "阅读资料", "book": "阅读资料", "course": "教育课程",
    "learningresource": "教育课程", "softwareapplication": "工具", "webapplication": "工具", "product": "产品", "organization": "组织",
    "scholarlyarticle": "论文", "report": "论文",
}
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "gitee.com", "bitbucket.org")
REPOSITORY_RESERVED = (
    "about", "apps", "collections", "contact", "dashboard", "docs", "events", "explore", "features", "issues", "login", "marketplace", "new",
    "notifications", "orgs", "organizations", "pricing", "pulls", "search", "security", "sessions", "settings", "site", "sponsors", "stars", "topics",
    "trending", "users",
)
#: type: (domains, path patterns, keywords, title patterns)
RESOURCE_RULES = {
    "文档": (("readthedocs.io", "developer.mozilla.org"), ("/docs", "/doc/", "/reference", "/manual", "/guide", "/learn"),
            ("documentation", "docs", "reference", "文档", "手册", "官方文档"), ("[Dd]ocumentation", "[Rr]eference", "文档", "手册")),
    "博客": (("medium.com", "juejin.cn", "segmentfault.com", "csdn.net", "cnblogs.com", "infoq.cn", "dev.to"), ("/blog", "/posts", "/article"),
            ("blog", "博客", "article", "文章"), ("[Bb]log", "博客", "文章")),
    "教程": ((), ("/tutorial", "/getting-started", "/quickstart", "/how-to"), ("tutorial", "教程", "quickstart", "getting started", "入门", "实践"),
            ("[Tt]utorial", "教程", "入门", "Quickstart")),
    "仓库": (("github.com", "gitlab.com", "gitee.com", "bitbucket.org"), (), ("repository", "repo", "仓库", "source code"), ("GitHub", "GitLab")),
    "论文": (("arxiv.org", "acm.org", "ieee.org"), ("/abs/", "/pdf/"), ("paper", "论文", "research", "preprint"), ("[Pp]aper", "论文", "[Rr]esearch")),
    "工具": ((), ("/download", "/cli"), ("tool", "工具", "cli", "plugin", "extension"), ("[Tt]ool", "工具", "CLI")),
}
INTENT_RULES = {
    "学习": ("tutorial", "教程", "入门", "guide", "learn", "课程"), "参考": ("reference", "documentation", "文档", "手册", "api"),
    "下载": ("download", "release", "安装", "setup"), "排障": ("troubleshoot", "debug", "debugging", "faq", "error", "故障", "排查"),
}
QUALITY_RULES = {
    "官方": ((), ("official", "官方")),
    "社区": (("medium.com", "juejin.cn", "segmentfault.com", "csdn.net", "cnblogs.com", "dev.to"), ("community", "社区")),
}
RESOURCE_PRIORITY = ("文档", "教程", "论文", "仓库", "工具", "产品", "博客", "阅读资料", "教育课程", "组织", "未知")
GENERIC_FOLDERS = (
    "其他", "未分类", "学习", "收藏", "书签", "资料", "文档", "教程", "docs", "doc", "documentation", "blog", "blogs", "article", "articles", "misc", "general",
    "home", "index", "www",
)
DOMAIN_NAMES = {"zhihu.com": "知乎", "csdn.net": "CSDN", "github.com": "GitHub", "gitbook.com": "GitBook", "gitbook.io": "GitBook"}
TOKEN_NAMES = {"api": "API", "aws": "AWS", "css": "CSS", "html": "HTML", "json": "JSON", "llm": "LLM", "github": "GitHub"}
#: Words of up to four letters that are shown in capitals.
ACRONYMS = ("api", "sdk", "cli", "llm", "aws", "gcp", "css", "html", "json", "yaml")
#: A slogan of a platform names a place of the first list and people or things of the second.
SLOGAN_PLACES = ("平台", "社区", "官网", "文档中心", "官方网站", "在线文档", "下载app")
SLOGAN_SUBJECTS = ("开发者", "开源", "技术", "代码", "创作", "用户", "文档")
RESOURCE_ALIASES = {
    "documentation": "文档", "doc": "文档", "docs": "文档", "blog": "博客", "tool": "工具", "repository": "仓库", "repo": "仓库", "paper": "论文",
}
#: Words of a path that say what kind of page it is.
URL_TYPES = {
    "docs": "文档", "documentation": "文档", "blog": "博客", "posts": "博客", "article": "博客", "articles": "博客", "tool": "工具", "tools": "工具",
    "repo": "仓库", "repos": "仓库", "github": "仓库", "paper": "论文", "papers": "论文", "arxiv": "论文",
}
OTHER, UNSORTED, UNKNOWN = "其他", "其他/未分类", "未知"
OFFICIAL, COMMUNITY, POOR, FREQUENT = "官方", "社区", "低信息量页", "高频访问候选"
FETCHED, TRUSTED = "抓取成功", "受信任访问"
PLATFORM_ROOTS = ("开发工具", "开源项目", "技术博客")
#: Fields of the signal column that evidence rests on.
SCORE_FIELDS = {
    "domain": ("identity.domain",),
    "keywords": (
        "content.title_candidates", "content.preferred_title", "content.preferred_description", "content.keywords_text", "content.language",
        "structure.site_name", "structure.brand_terms",
    ),
    "title": ("content.title_candidates", "structure.headings_h1", "structure.site_name"),
    "content": (
        "content.semantic_text", "content.preferred_description", "content.main_text", "structure.page_type_hints", "structure.site_type_candidates",
        "structure.schema_types",
    ),
}
RESOURCE_FIELDS = {
    "structured_facet": ("structure.resource_facets",), "domain": ("identity.domain",), "repository_url": (), "url": ("identity.path_segments",),
    "keyword": ("content.semantic_text", "content.keywords_text"), "title": ("content.title_candidates", "structure.headings_h1"),
    "extension": ("identity.path_segments",),
}
TOPIC_FIELDS = {
    "site_profile": ("structure.site_name", "structure.brand_terms"), "title": ("content.title_candidates",), "name": ("identity.saved_title",),
    "keywords": ("content.keywords_text",), "url_path": ("identity.path_segments",), "domain": ("identity.domain", "identity.registrable_domain"),
}
GATE_FIELDS = (
    "health_access.fetch_status", "health_access.link_health", "health_access.review_required", "health_access.trusted_override",
    "health_access.fetch_context",
)
#: Fields that every feature set draws on.
FEATURE_FIELDS = (
    "identity.domain", "identity.registrable_domain", "identity.path_segments", "identity.canonical_identity", "content.preferred_title",
    "content.title_candidates", "content.preferred_description", "content.semantic_text", "content.keywords_text", "structure.resource_facets",
    "structure.source_facets", "structure.site_name", "structure.brand_terms", "structure.page_type_hints", "health_access.quality_facets",
    "context_time.time_bucket",
)
# fmt: on
MIN_SCORE, CONFIRM_THRESHOLD, AUTO_CONFIDENCE, ROOT_MARGIN = 15, 25, 0.55, 2.0
WEIGHTS = {"domain": 30, "keyword": 40, "title": 20, "content": 15}
