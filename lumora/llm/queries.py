"""The queries of this subpackage, by the name under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, neighbors, prefixes
from .clustering import op13_centroids
from .decontam import op5_decontamination
from .licenses import op8_licenses
from .neighbors import op12_embeddings
from .packing import op10_packing
from .prefixes import op11_conversations
from .quality import op2_quality
from .secrets import op3_secrets
from .sharding import op1_sharding
from .simhash import op7_simhash
from .spans import op4_sentence_spans
from .sstable import op6_sstable
from .toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding, op2_quality, op3_secrets, op4_sentence_spans, op5_decontamination, op6_sstable, op7_simhash, op8_licenses, op9_toxicity, op10_packing,
        op11_conversations, op12_embeddings, op13_centroids,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversations": prefixes.SQL, "op12_embeddings": neighbors.SQL, "op13_centroids": clustering.SQL}
