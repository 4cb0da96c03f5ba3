"""The queries of this subpackage and their SQL."""

from . import bpe, fingerprints, langid, lines, neardup, packing, pii, secrets, sharding, topk

MODULES = (sharding, lines, bpe, topk, neardup, fingerprints, pii, packing, secrets, langid)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
