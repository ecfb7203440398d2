"""The queries of this subpackage and their SQL, as the entry file registers them."""

from __future__ import annotations

from siftlake.llm.bpe import op8_bpe
from siftlake.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from siftlake.llm.language import op4_language
from siftlake.llm.line_dedup import OP10_SQL, op10_line_dedup
from siftlake.llm.mixing import OP7_SQL, op7_mixing
from siftlake.llm.quality import op9_quality
from siftlake.llm.simhash import op3_simhash
from siftlake.llm.topk import OP5_SQL, op5_topk
from siftlake.llm.url_filter import OP6_SQL, op6_url_filter
from siftlake.llm.warc import op2_warc

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_simhash, op4_language, op5_topk, op6_url_filter, op7_mixing, op8_bpe, op9_quality, op10_line_dedup)}
SQL = {"op1_exact_dedup": OP1_SQL, "op5_topk": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_mixing": OP7_SQL, "op10_line_dedup": OP10_SQL}
