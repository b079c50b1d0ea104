"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from folio.llm import exact_dedup, language, licences, media, packing, pieces, sharding, simhash, token_files, url_filter

MODULES = [packing, media, sharding, licences, url_filter, token_files, exact_dedup, pieces, simhash, language]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
