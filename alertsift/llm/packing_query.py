"""Query of the packer. SQL cannot encode; tests hold the pieces against the tokenizer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from .catalog import query
from .common import table


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return pieces.select(
        "doc_id", long("start"), long("length"), F.crc32("ids").alias("ids_crc32"), long("doc_tokens"), long("sequence_id"), long("offset")
    )


@query("op8_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
