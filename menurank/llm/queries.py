"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

import corpus_pipeline

from . import align, bpe, fim, jaccard, langid, lm, packing, pii, quality, sharding, spotsigs, topk, urls

MODULES = [topk, jaccard, packing, bpe, quality, urls, lm, sharding, pii, spotsigs, align, langid, fim]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
