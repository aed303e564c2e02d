"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from .bpe import op4_bpe
from .clusters import OP12_SQL, op12_centroid_clustering
from .decontaminate import OP7_SQL, op7_decontaminate
from .jaccard import OP10_SQL, op10_ngram_jaccard_join
from .licenses import op6_license_scan
from .lines import OP2_SQL, op2_line_dedup
from .ranking import OP11_SQL, op11_ranked_search
from .substrings import OP1_SQL, op1_substring_dedup
from .toxicity import op3_toxicity
from .quality import op8_quality_rules
from .secrets import op5_secret_scan
from .sharding import op9_sharding
from .simhash import op13_simhash

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_line_dedup, op3_toxicity, op4_bpe, op5_secret_scan, op6_license_scan, op7_decontaminate, op8_quality_rules, op9_sharding, op10_ngram_jaccard_join,
    op11_ranked_search, op12_centroid_clustering, op13_simhash)}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op7_decontaminate": OP7_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_ranked_search": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL}
