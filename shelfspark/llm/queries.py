"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codes, decontaminate, exactdedup, licenses, negatives, ngramjoin, packing, pii, quality, tokenbin, toxicity, urlfilter, warc

_MODULES = (decontaminate, urlfilter, licenses, ngramjoin, quality, exactdedup, packing, warc, tokenbin, toxicity, codes, negatives, pii)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
