"""The subpackage's queries and their DuckDB twins."""

from __future__ import annotations

from . import annulus, collocations, decontaminate, maxscore
from . import quality_rules as rules
from .annulus import op13_annulus_clusters
from .backoff_lm import op5_backoff_lm
from .chunk_dedup import op7_chunk_dedup
from .collocations import op12_collocations
from .decontaminate import op11_winnowing
from .kd_sharding import op4_kd_sharding
from .knn_quality import op1_knn_quality
from .maxscore import op2_maxscore_topk
from .mixing import op8_source_mixing
from .ngram_jaccard import op10_ngram_jaccard
from .piece_transducer import op9_piece_transducer
from .quality_rules import op3_quality_rules
from .suffix_dedup import op6_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_knn_quality,
        op2_maxscore_topk,
        op3_quality_rules,
        op4_kd_sharding,
        op5_backoff_lm,
        op6_suffix_dedup,
        op7_chunk_dedup,
        op8_source_mixing,
        op9_piece_transducer,
        op10_ngram_jaccard,
        op11_winnowing,
        op12_collocations,
        op13_annulus_clusters,
    )
}

ORACLE_SQL = {
    "op2_maxscore_topk": maxscore.SQL,
    "op3_quality_rules": rules.SQL,
    "op11_winnowing": decontaminate.SQL,
    "op12_collocations": collocations.SQL,
    "op13_annulus_clusters": annulus.SQL,
}
