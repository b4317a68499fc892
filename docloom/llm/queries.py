"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import chunking, leakage, lookalikes, mixing, mojibake, nearcopies, pairs, scans, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scans.p1_found,
    "p1_paragraphs": scans.p1_paragraphs,
    "p2_found": mojibake.p2_found,
    "p2_restored": mojibake.p2_restored,
    "p3_found": chunking.p3_found,
    "p3_pieces": chunking.p3_pieces,
    "p3_rebuilt": chunking.p3_rebuilt,
    "p4_defects": pairs.p4_defects,
    "p4_found": pairs.p4_found,
    "p5_found": nearcopies.p5_found,
    "p5_groups": nearcopies.p5_groups,
    "p6_found": lookalikes.p6_found,
    "p6_forms": lookalikes.p6_forms,
    "p7_found": leakage.p7_found,
    "p7_near": leakage.p7_near,
    "p8_mix": mixing.p8_mix,
    "p8_checks": mixing.p8_checks,
    "p8_shares": mixing.p8_shares,
    "p9_found": truncation.p9_found,
    "p9_limits": truncation.p9_limits,
    "p9_rates": truncation.p9_rates,
}

ORACLE_SQL: dict[str, str] = {
    "p3_found": chunking.P3_FOUND_SQL,
    "p3_rebuilt": chunking.P3_REBUILT_SQL,
    "p5_found": nearcopies.P5_FOUND_SQL,
    "p5_groups": nearcopies.P5_GROUPS_SQL,
    "p6_found": lookalikes.P6_FOUND_SQL,
    "p7_found": leakage.P7_FOUND_SQL,
    "p8_checks": mixing.P8_CHECKS_SQL,
}
