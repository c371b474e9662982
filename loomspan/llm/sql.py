"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from loomspan.llm import jaccard, line_dedup, mixing, topk, url_filter


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op4_mixing": mixing.SQL, "op5_url_filter": url_filter.SQL, "op9_topk": topk.SQL, "op10_jaccard": jaccard.SQL}
