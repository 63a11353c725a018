"""All queries of this subpackage and their SQL."""

from weft.llm import chat, html, jaccard, langid, mixing, quality, repeats, segments, tokens, topk

MODULES = (quality, tokens, langid, chat, jaccard, mixing, segments, topk, html, repeats)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
