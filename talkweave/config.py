"""Constants that define results.

Fixed values: thresholds, weights and limits of the operators' semantics.
"""

SHORT_CHARS, MAX_CHARS, HARD_SPLIT, CONTEXT_CHARS = 150, 2500, 3000, 80
PHRASE_WEIGHT, TOKEN_WEIGHT, SPEAKER_WEIGHT, ROLE_WEIGHT = 2, 1, 3, 2
MAX_TOKENS, MAX_PHRASES, SNIPPET = 8, 2, 200
RRF_K, RRF_KEYWORD, RRF_VECTOR, SHORT_PENALTY, CANDIDATES = 60, 1.2, 1.0, 0.9, 30
RERANK_POOL, EXCERPT = 30, 600
SIMILARITY_GATE = 0.4
CITATION_CHARS = 160
QA_LIMIT, REPORT_LIMIT, NEIGHBOUR_CHARS, EVIDENCE_CHARS = 5, 10, 500, 4000
MAP_BATCH, VECTORS_PER_QUERY, KEYWORD_HITS_PER_QUARTER = 20, 100, 40
SPIKE_RATIO, CELL_SAMPLE, MIN_AGENDA_CHARS, MIN_MONTHS, TOP_AGENDA = 1.8, 30, 8, 3, 40
EMBED_ITEMS, EMBED_CHARS = 800, 120_000
TURN_SPEAKER_MISSING, TURN_SHORT_CHARS, TURN_SHORT_RATE = 0.01, 20, 0.20
CHUNK_DATE_NULL, CHUNK_SPEAKER_MISSING, CHUNK_BLANK, CHUNK_SHORT, CHUNK_LONG, CHUNK_SOURCE_MISSING = 0.05, 0.10, 0.05, 0.20, 0.05, 0.01
CHUNK_GATE_SHORT_CHARS, CHUNK_GATE_LONG_CHARS = 100, 3000
SKIP_DATE_NULL, SKIP_BLANK = 0.5, 0.2
PROBE_CHARS, PROBES, PROBE_LEAST = 20, 5, 10
RATE_WINDOW_SECONDS, LLM_PER_MINUTE, GENERAL_PER_MINUTE, DAILY_COST = 60, 5, 60, 1.0
RECALL_CUTS, MRR_CUT = (5, 10), 10
SCOPE_LIMIT_MB, ROW_KB = 350, {"chunk": 2.3, "indexed": 21.0, "raw": 6.5}
