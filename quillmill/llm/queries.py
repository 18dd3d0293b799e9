"""Registered queries of the subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from quillmill.llm.fim import OP13_SQL
from quillmill.llm.mtree import OP5_SQL
from quillmill.llm.orchard import OP11_SQL

#: Query name → module of this subpackage that holds it.
WHERE = {"op1_simhash": "simhash", "op2_langid": "langid", "op3_token_count": "token_count", "op4_bpe": "bpe", "op5_topk": "mtree", "op6_html_text": "html_text", "op7_mixing": "mixing", "op8_license_scan": "license_scan", "op9_chroma": "chroma", "op10_id_shards": "idcodec", "op11_orchard": "orchard", "op12_secret_scan": "secret_scan", "op13_fill_in_middle": "fim"}

SQL: dict[str, str] = {"op5_topk": OP5_SQL, "op11_orchard": OP11_SQL, "op13_fill_in_middle": OP13_SQL}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"quillmill.llm.{module}"), name) for name, module in WHERE.items()}
