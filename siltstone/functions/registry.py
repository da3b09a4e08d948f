"""The functions that SQL can call by name once they are registered."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltstone.functions import content, fuzzy

FUNCTIONS = {
    "byte_entropy": content.entropy, "repeated_blocks": content.repeated_blocks, "adler32": content.adler32, "fnv1a": content.fnv1a, "crc16": content.crc16,
    "ssdeep": fuzzy.ssdeep, "tlsh": fuzzy.tlsh, "phash": fuzzy.phash, "set_sketch": fuzzy.set_sketch,
}


def register(spark: SparkSession) -> list[str]:
    """Register all FUNCTIONS; their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
