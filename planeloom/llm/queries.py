"""The queries of this subpackage, and their SQL where it can express them."""

import importlib.util

MODULES = ["language_id", "token_count", "mixing", "license_scan", "ogg", "exact_topk", "simhash", "suffix_dedup", "bpe", "quality_mil"]

QUERIES, SQL = {}, {}
for _m in MODULES:
    if importlib.util.find_spec(f"{__package__}.{_m}"):
        _x = importlib.import_module(f"{__package__}.{_m}")
        QUERIES |= _x.QUERIES
        SQL |= getattr(_x, "SQL", {})
