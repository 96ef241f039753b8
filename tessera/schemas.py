"""Explicit schemas and the fixed values the operators must share with the
original application (keyword lists, topic names, candidate labels).

Everything under "FIXED VALUES" must stay exactly as written: results depend
on the literal strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's values)
# ---------------------------------------------------------------------------

# News relevance filter: keywords (occurrence and distinct counts).
AI_KEYWORDS = [
    "artificial intelligence",
    "machine learning",
    "deep learning",
    "neural network",
    "large language model",
    " llm ",
    "generative AI",
    "a.i.",
    " ai ",
]

# News relevance filter: accepted sources (compared lower-cased).
REPUTABLE_SOURCES = [
    "associated press",
    "forbes",
    "business insider",
    "reuters",
    "politico",
    "the guardian",
    "cnbc",
    "cnn",
    "fox news",
    "the washington post",
    "the seattle times",
    "new york post",
    "abc news",
    "bloomberg",
]

# Developer-post relevance filter: keyword stems (substring match), in the
# original order, duplicates included.
AI_STEMS = [
    "hallucin", "factual", "verif", "accurac",
    "bias", "fairness", "discriminat", "intersectional",
    "ai safety", "responsible ai", "align", "guardrail", "red team",
    "explain", "interpret", "transparen", "audit",
    "privac", "pii", "data leak", "data retent", "consent",
    "prompt inject", "jailbreak", "adversarial",
    "misinform", "disinform", "wrong", "deepfake", "fake news",
    "ethic", "governance", "regulat", "complian", "ai act", "polic",
    "agentic", "autonomous", "automat", "workflow",
    "retriev", "grounding", "context",
    "observ", "model drift", "monitor",
    "sustainab", "carbon footprint", "energy consumpt", "green ai",
    "layoff", "job displac", "reskill", "redundanc", "unemploy",
    "copyright", "licens", "plagiar", "training data", "original",
    "inference cost", "vendor lock", "productiv", "augment",
    "toxic", "harmful",
    "artificial general intelligence", "human-in-the-loop", "human in the loop",
    "human in the loop", "human-in-the-loop", "context manag", "session context",
    "llm", "coding assistant", "ai assistant", "prompt engineer", "token",
    "context window", "context drift",
    "wrong context", "lost context", "confabul", "confident",
]

# Stems matched as whole words instead of substrings.
SHORT_EXACT = ["rag", "agi", "pii"]

# Concept patterns counted per year (word-boundary regexes on lower-cased text).
CONCEPT_PATTERNS = {
    "environment": r"\benvironment\b",
    "context issues": r"\bcontext\b|\bcontext issues\b|\bcontext window\b",
    "hallucinations": r"\bhallucination\b|\bhallucinations\b",
    "intellectual property": r"\bip\b|\bintellectual property\b|\bcopyright\b|\blicens\w*\b",
    "safety": r"\bsafety\b|\balignment\b|\bmisuse\b",
}

# Topic keywords by topic id, as used by similarity search (id -> name).
NEWS_TOPICS = [
    "jobs, workers, employees",
    "data, security, cybersecurity",
    "generative, language, models",
    "tech, industry, world",
    "google, openai, microsoft",
    "business, companies, services",
    "people, think, human",
    "government, president, china",
]
DEV_TOPICS = [
    "code, engineering, development",
    "openai, models, google",
    "tools, time, work",
    "ml, algorithms, artificial",
    "enterprise, companies, business",
    "customer, automation, chatbots",
    "financial, healthcare, predictive",
    "agentic, autonomous, workflows",
]

# Topic ids in the order in which both corpora show them.
DISPLAY_ORDER = [6, 5, 7, 4, 1, 2, 0, 3]

# Markup removal, in this order: code blocks, inline code, images, links, tags.
MARKUP_REWRITES = [
    (r"```[\s\S]*?```", " "),
    (r"`[^`]*`", " "),
    (r"!\[[^\]]*\]\([^\)]*\)", " "),
    (r"\[([^\]]+)\]\([^\)]*\)", "$1"),
    (r"<[^>]+>", " "),
]

# Zero-shot candidate labels.
PRIMARY_LABELS = [
    "a coding tutorial, technical guide, or software implementation walkthrough with little discussion of societal implications",
    "an opinion piece, analysis, or commentary on AI's consequences for society, law, environment, or ethics",
]
SECONDARY_LABELS = [
    "discussion of the environmental impact or energy consumption of AI",
    "discussion of legal, regulatory, or policy issues related to AI",
    "discussion of ethical concerns, bias, or fairness in AI systems",
    "discussion of AI's impact on jobs, employment, or the economy",
    "discussion of AI in geopolitics, international competition, or national security",
    "discussion of how AI is portrayed in media or public opinion",
    "discussion of AI safety, alignment, or existential risks",
]

# LIKE patterns of the monthly secondary-label chart, in chart order.
SECONDARY_LABEL_PATTERNS = [
    "%discussion of AI in geopolitics, international competition, or national security%",
    "%discussion of AI safety, alignment, or existential risks%",
    "%discussion of AI's impact on jobs, employment, or the economy%",
    "%discussion of ethical concerns, bias, or fairness in AI systems%",
    "%discussion of how AI is portrayed in media or public opinion%",
    "%discussion of legal, regulatory, or policy issues related to AI%",
    "%discussion of the environmental impact or energy consumption of AI%",
]

SENTIMENT_LABELS = ["positive", "neutral", "negative"]
URL_PREFIX = "https://hashnode.com/post/"
EMBEDDING_WIDTH = 384
UNSURE = "UNSURE"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

NEWS_CSV = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sitename", T.StringType()),
])

_NODE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("content", T.StructType([T.StructField("markdown", T.StringType())])),
    T.StructField("tags", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("slug", T.StringType()),
    ]))),
])

# One cursor-paged response of the developer-post API.
PAGE_RESPONSE = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("tag", T.StructType([
            T.StructField("posts", T.StructType([
                T.StructField("pageInfo", T.StructType([
                    T.StructField("hasNextPage", T.BooleanType()),
                    T.StructField("endCursor", T.StringType()),
                ])),
                T.StructField("edges", T.ArrayType(T.StructType([
                    T.StructField("node", _NODE),
                ]))),
            ])),
        ])),
    ])),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("message", T.StringType()),
    ]))),
])

SCORES = T.StructType([
    T.StructField("positive", T.DoubleType()),
    T.StructField("neutral", T.DoubleType()),
    T.StructField("negative", T.DoubleType()),
])
