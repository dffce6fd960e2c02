"""All tunables and closed word sets of the engine in one place."""

from __future__ import annotations

# Fixed values that results depend on.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "of", "to", "for", "and", "or", "but", "with", "by", "from", "as", "that", "this", "these", "those", "be", "been", "being", "it", "its"]
FACTOID_WH = ["who", "what", "when", "where", "which", "whom"]
DESCRIPTIVE_WH = ["how", "why"]
COMPARISON = ["compare", "comparison", "versus", "vs", "difference", "differences", "contrast", "similar", "both", "neither", "between", "respectively"]
NEGATION = ["not", "never", "no", "except", "without", "excluding", "neither", "nor", "non", "non-member", "outside"]
DETERMINERS = ["the", "a", "an"]
AUXILIARIES = ["is", "are", "was", "were", "has", "have", "had", "does", "did", "can", "could", "will", "would"]
FRAGMENT_START = "[a-z*•–—|·]"
EVIDENTIALITY = {
    "definitions": r"\bis\s+a\b|\bwas\s+defined\s+as\b|\brefers\s+to\b|\bmeans\b|\brepresents\b",
    "biographies": r"\bborn\s+in\b|\bdied\s+in\b|\bwon\s+the\b|\bfounded\b|\bcreated\b|\binvented\b",
    "causality": r"\bbecause\b|\btherefore\b|\bas\s+a\s+result\b|\bwhich\s+led\s+to\b|\bcaused\b|\bresulted\s+in\b",
    "superlatives": r"\bthe\s+first\b|\bthe\s+only\b|\bthe\s+largest\b|\bthe\s+most\b|\bthe\s+best\b",
    "temporal": r"\bin\s+\d{4}\b|\bduring\s+\d{4}\b|\bfrom\s+\d{4}\s+to\s+\d{4}\b",
}
TEMPORAL_INTENT = "recent|latest|current|now|today|when"
ANSWER_KEYS = ["value", "normalized_value", "aliases", "normalized_aliases", "human_answers"]
FIELD_HINTS = {
    "question": ["question", "query"],
    "answers": ["answers", "answer", "target", "short_answers"],
    "context": ["context", "passage", "passages", "document", "documents", "text", "content", "search_results"],
    "title": ["title", "titles", "subject"],
}

# Fixed values that results depend on, in figures.
CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
DEDUP_PREFIX, ID_PREFIX = 200, 64
BATCH_ROWS = 10_000
ROW_CAP = 5_000
DATASETS = ["nq", "hotpot", "trivia", "wiki"]
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DEPTHS = {"factoid": (15, 15, 8), "descriptive": (20, 20, 12), "multi_hop": (30, 30, 20)}
SENTENCE_TOKENS = (5, 150)
TOKEN_BUDGET = {"factoid": 400, "descriptive": 700, "multi_hop": 1000}
DUPLICATE_EXACT, DUPLICATE_SOFT = 0.92, 0.80
WEIGHTS = {"factoid": (0.35, 0.25, 0.15, 0.15, 0.10), "descriptive": (0.50, 0.20, 0.15, 0.10, 0.05), "multi_hop": (0.40, 0.25, 0.15, 0.10, 0.10)}
GRAPH_COSINE = 0.78
COMPLEXITY = {"low": (5, 1, 2), "medium": (12, 3, 5)}
MINIMUM_EVIDENCE, DEFAULT_MINIMUM = {"factoid": 2, "descriptive": 4, "multi_hop": 6}, 4
COMPLEXITY_BUMP = {"low": 0, "medium": 0, "high": 1}
MAX_EXPANSION, DEFAULT_EXPANSION = {"factoid": 2, "descriptive": 3, "multi_hop": 4}, 3
CURRENT_YEAR = 2026
HASH_DIM = 256
