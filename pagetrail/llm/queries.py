"""The operators' queries and their SQL."""

from __future__ import annotations

from .decontamination import op1_spaced_seeds
from .jaccard_join import op4_divide_skip
from .line_dedup import op3_template_tree
from .packing import op8_karmarkar_karp
from .periodic_runs import OP13_SQL, op13_scale_tiles
from .quality import op9_naive_bayes_svm
from .secrets import op2_randomness_battery
from .sharding import OP6_SQL, op6_histogram_sort
from .substring_dedup import OP11_SQL, op11_difference_cover
from .toxicity import op5_kneser_ney
from .topk_search import OP10_SQL, op10_threshold_algorithm
from .vector_codes import OP12_SQL, op12_dual_tree_lloyd
from .warc import OP7_SQL, op7_content_addressed

QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_randomness_battery": op2_randomness_battery,
    "op3_template_tree": op3_template_tree,
    "op4_divide_skip": op4_divide_skip,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_content_addressed": op7_content_addressed,
    "op8_karmarkar_karp": op8_karmarkar_karp,
    "op9_naive_bayes_svm": op9_naive_bayes_svm,
    "op10_threshold_algorithm": op10_threshold_algorithm,
    "op11_difference_cover": op11_difference_cover,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_scale_tiles": op13_scale_tiles,
}
ORACLES = {"op6_histogram_sort": OP6_SQL, "op7_content_addressed": OP7_SQL, "op10_threshold_algorithm": OP10_SQL, "op11_difference_cover": OP11_SQL, "op12_dual_tree_lloyd": OP12_SQL, "op13_scale_tiles": OP13_SQL}
