"""The queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from wirelake.llm import op01_license, op02_quality, op03_embedding, op04_packing, op05_secrets, op06_minhash, op07_html, op08_tokens, op09_warc, op10_mixing

_MODULES = (op01_license, op02_quality, op03_embedding, op04_packing, op05_secrets, op06_minhash, op07_html, op08_tokens, op09_warc, op10_mixing)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
