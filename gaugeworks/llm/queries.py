"""The registered queries of this subpackage, one per operator, and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.decontaminate import op10_decontamination
from gaugeworks.llm.exact import OP1_SQL, op1_exact_dedup
from gaugeworks.llm.manifest import OP11_SQL, op11_manifest
from gaugeworks.llm.minhash import op12_minhash
from gaugeworks.llm.passages import op3_repeated_passages
from gaugeworks.llm.pieces import op4_sentencepiece
from gaugeworks.llm.quality import op2_quality
from gaugeworks.llm.repeats import op13_runs
from gaugeworks.llm.secrets import op7_secret_scans
from gaugeworks.llm.simhash import op9_simhash
from gaugeworks.llm.tokens import op5_token_counts
from gaugeworks.llm.urls import OP6_SQL, op6_url_filters
from gaugeworks.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_url_filters": op6_url_filters,
    "op7_secret_scans": op7_secret_scans,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_manifest": op11_manifest,
    "op12_minhash": op12_minhash,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op6_url_filters": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_manifest": OP11_SQL,
}
