"""The registered queries of this subpackage and their SQL."""

from vectide.llm import decontam, exact, fixity, jaccard, language, licenses, mixing, pii, ppm, toxicity

MODULES = (pii, fixity, exact, toxicity, jaccard, mixing, licenses, decontam, language, ppm)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
