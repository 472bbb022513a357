"""The registered queries over the synthetic tables, one per operator, and their SQL where it can express them."""

from __future__ import annotations

from . import hpylm, langid, mixing, neighbours, packing, quality, sharding, simhash, toxicity, urls
from .common import table

QUERIES = {
    "op1_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
    "op2_language_id": lambda s, d: langid.query(table(s, d, "documents")),
    "op3_url_filters": lambda s, d: urls.query(table(s, d, "pages")),
    "op4_simhash": lambda s, d: simhash.query(table(s, d, "documents")),
    "op5_embedding_neighbours": lambda s, d: neighbours.query(table(s, d, "embeddings")),
    "op6_sharding": lambda s, d: sharding.query(table(s, d, "documents")),
    "op7_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
    "op8_quality_rules": lambda s, d: quality.query(table(s, d, "documents")),
    "op9_packing": lambda s, d: packing.query(table(s, d, "documents")),
    "op10_hpylm": lambda s, d: hpylm.query(table(s, d, "documents")),
}
ORACLE_SQL = {"op3_url_filters": urls.oracle(), "op8_quality_rules": quality.oracle()}
