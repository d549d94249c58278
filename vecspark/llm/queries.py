"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .language import op13_language_id
from .lm_scoring import op10_lm_scoring
from .media import op8_media
from .nearest import op7_nearest
from .near_dedup import op1_near_dedup
from .packing import op2_packing
from .periodic import op11_periodic
from .quality import op6_quality
from .substring_dedup import op9_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op3_token_files
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_token_files, op4_bpe, op5_token_counts, op6_quality, op7_nearest, op8_media, op9_substring_dedup, op10_lm_scoring, op11_periodic, op12_whitening, op13_language_id)}
ORACLES: dict[str, str] = {name: f.oracle for name, f in QUERIES.items() if hasattr(f, "oracle")}
