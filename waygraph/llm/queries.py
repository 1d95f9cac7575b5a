"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waygraph.llm import importance, neardup, quality_rules, vector_codes
from waygraph.llm.decontaminate import op3_decontamination
from waygraph.llm.importance import op13_importance
from waygraph.llm.langid import op2_language_id
from waygraph.llm.licenses import op8_license_scan
from waygraph.llm.neardup import op6_minhash_neardup
from waygraph.llm.page_text import op12_page_text
from waygraph.llm.quality_fm import op7_quality_fm
from waygraph.llm.quality_rules import op1_quality_rules
from waygraph.llm.sentencepieces import op9_sentencepiece
from waygraph.llm.sharding import op4_sharding
from waygraph.llm.token_counts import op10_token_counts
from waygraph.llm.toxicity import op5_toxicity
from waygraph.llm.vector_codes import op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_language_id, op3_decontamination, op4_sharding, op5_toxicity, op6_minhash_neardup, op7_quality_fm, op8_license_scan, op9_sentencepiece, op10_token_counts, op11_vector_codes, op12_page_text, op13_importance)
}

SQL: dict[str, str] = {"op1_quality_rules": quality_rules.SQL, "op6_minhash_neardup": neardup.SQL, "op11_vector_codes": vector_codes.SQL, "op13_importance": importance.SQL}
