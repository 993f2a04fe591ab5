"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bitplanes import op6_bit_planes
from .edit_counts import op3_edit_aware_counts
from .hard_negatives import OP12_SQL, op12_radix_negatives
from .interleaved import op2_interleaved_media
from .mixing import OP5_SQL, op5_weighted_fair_queueing
from .near_dedup import op7_weighted_minhash
from .packing import op4_concat_and_cut
from .perspectives import OP10_SQL, op10_perspective_rotation
from .quality import op1_isolation_forest
from .resampling import OP11_SQL, op11_importance_resampling
from .substrings import op13_fixed_block_anchors
from .toxicity import op9_string_kernel_svm
from .wrappers import op8_wrapper_induction

QUERIES = {f.__name__: f for f in (op1_isolation_forest, op2_interleaved_media, op3_edit_aware_counts, op4_concat_and_cut, op5_weighted_fair_queueing, op6_bit_planes, op7_weighted_minhash, op8_wrapper_induction, op9_string_kernel_svm, op10_perspective_rotation, op11_importance_resampling, op12_radix_negatives, op13_fixed_block_anchors)}

ORACLE_SQL: dict[str, str] = {"op5_weighted_fair_queueing": OP5_SQL, "op10_perspective_rotation": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_radix_negatives": OP12_SQL}
