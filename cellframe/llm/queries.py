"""The registered queries of this subpackage and, where SQL can express one, the SQL for it."""

from __future__ import annotations

from .forest import op10_nearest
from .hnsw import OP9_SQL, op9_embedding_dedup
from .langid import op2_langid
from .linededup import OP5_SQL, op5_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .packing import op4_packing
from .quality import op8_quality
from .sharding import OP6_SQL, op6_sharding
from .simhash import op7_simhash
from .token_counts import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_langid": op2_langid,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_sharding": OP6_SQL, "op9_embedding_dedup": OP9_SQL}
