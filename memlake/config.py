"""Parameters of the memory engine.

Fixed values: these must equal the values the original service uses, so results agree.
    decay rate lambda ............ 0.01 per hour
    fidelity thresholds .......... hot 2.0, warm 1.0, cool 0.3, faded 0.01
    candidate limit .............. 50 per context request
    status sample ................ 100 candidates
    search result limit .......... 10; full-text candidates 2 x limit
    full-text boost .............. 0.5 added to cosine for a full-text hit
    similarity cut ............... keep rows with boosted similarity > 0.25
    context budget ............... 8000 characters (token estimate = chars / 4)
    chunk size ................... 2000 characters, paragraphs split on blank lines
    chunk summary / essence ...... first 150 / 50 characters
    ingest importance ............ 2, tags document, rag, <file name>, type knowledge
    local embedding size ......... 128 buckets; token +1, adjacent char pair +0.5
    k-means ...................... k = 5, at most 20 iterations
    retention .................... drop when not saved, importance < 3, idle > 30 days
    id length .................... 16 hex chars of SHA-256; short id 7 chars
    fuzzy edit limits ............ 1 for names <= 4 chars, 2 for <= 10, else 3
    unscoped project key ......... "_untagged"
    memory types ................. conversation, knowledge, learning, decision, architecture
    sensitivities ................ public, internal, secret
    turn roles ................... user, assistant, system

Our own choices (the service leaves them to its storage engine): BM25 k1 = 1.2, b = 0.75,
idf floor 1e-6, tokens are lower-cased runs of letters and digits.
"""

from __future__ import annotations

from dataclasses import dataclass

DECAY_LAMBDA = 0.01
HOT, WARM, COOL, FADED = 2.0, 1.0, 0.3, 0.01
CANDIDATE_LIMIT = 50
STATUS_SAMPLE = 100
SEARCH_LIMIT = 10
FTS_BOOST = 0.5
SIMILARITY_CUT = 0.25
CHAR_BUDGET = 8000
CHUNK_SIZE = 2000
CHUNK_SEPARATOR = r"\n\n+"
SUMMARY_CHARS = 150
ESSENCE_CHARS = 50
INGEST_IMPORTANCE = 2.0
EMBED_DIM = 128
KMEANS_K = 5
KMEANS_MAX_ITER = 20
RETENTION_DAYS = 30
RETENTION_IMPORTANCE = 3.0
ID_CHARS = 16
SHORT_ID_CHARS = 7
UNTAGGED = "_untagged"
MEMORY_TYPES = ("conversation", "knowledge", "learning", "decision", "architecture")
SENSITIVITIES = ("public", "internal", "secret")
ROLES = ("user", "assistant", "system")
TIERS = ("hot", "warm", "cool", "faded", "gone")

BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6

# Letters kept by the local embedding besides a-z and 0-9 (Vietnamese alphabet), fixed value.
EMBED_EXTRA_LETTERS = (
    "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
)

# Reference time used by every registered query (2024-03-01 00:00 UTC): operators take `now`
# as a parameter instead of reading the wall clock.
NOW = 1709251200


@dataclass(frozen=True)
class Thresholds:
    hot: float = HOT
    warm: float = WARM
    cool: float = COOL
    faded: float = FADED


DEFAULT_THRESHOLDS = Thresholds()

# Sentences of the recall answers.
CONTEXT_LOG_NOTE = "(context log available — see vault .md file for details)"
NOT_FOUND_NOTE = ('No memory found with hash prefix "', '". Try brain_query to find available memories.')
TOO_SHORT_NOTE = "hash prefix needs at least 4 characters"
