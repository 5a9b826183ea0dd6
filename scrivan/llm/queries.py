"""The queries of this folder, by name; ``SQL`` has the same for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivan.llm import encodings, groups, leaks, lookalike, names, neardup, oracles, overlap, packing, pii, scan_noise
from scrivan.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: scan_noise.found(load(s, d, "ocr_results")),
    "p1_texts": lambda s, d: scan_noise.clean(load(s, d, "ocr_results")),
    "p2_found": lambda s, d: neardup.found(load(s, d, "document_records"), load(s, d, "ocr_results")),
    "p2_groups": lambda s, d: neardup.groups(load(s, d, "document_records"), load(s, d, "ocr_results")),
    "p3_found": lambda s, d: groups.found(load(s, d, "synth_manifest").dropDuplicates(["row_id"])),
    "p3_split": lambda s, d: groups.grouped_split(load(s, d, "synth_manifest").dropDuplicates(["row_id"])),
    "p4_found": lambda s, d: names.found(load(s, d, "document_metadata")),
    "p4_students": lambda s, d: names.linked(load(s, d, "document_metadata")),
    "p5_found": lambda s, d: overlap.found(load(s, d, "synth_manifest")),
    "p5_report": lambda s, d: overlap.report(load(s, d, "synth_manifest")),
    "p6_found": lambda s, d: lookalike.found(load(s, d, "ocr_results"), load(s, d, "ocr_comparison")),
    "p6_texts": lambda s, d: lookalike.texts(load(s, d, "ocr_results"), load(s, d, "ocr_comparison")),
    "p7_found": lambda s, d: pii.found(load(s, d, "ocr_results")),
    "p7_masked": lambda s, d: pii.masked(load(s, d, "ocr_results")),
    "p8_containers": lambda s, d: packing.containers(load(s, d, "documents"), VOCABULARY),
    "p10_found": lambda s, d: encodings.found(load(s, d, "documents")),
    "p10_texts": lambda s, d: encodings.texts(load(s, d, "documents")),
    "p10_ciphers": lambda s, d: encodings.ciphers(load(s, d, "documents")),
    "p9_found": lambda s, d: leaks.found(load(s, d, "documents"), load(s, d, "eval_items")),
    "p9_cleaned": lambda s, d: leaks.cleaned(load(s, d, "documents"), load(s, d, "eval_items")),
}
SQL: dict[str, str] = {"p3_found": oracles.GROUPS, "p5_found": oracles.OVERLAP, "p6_found": lookalike.found_sql(), "p9_found": oracles.LEAKS}
