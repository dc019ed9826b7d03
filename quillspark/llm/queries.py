"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontamination import op8_prefix_join
from quillspark.llm.language import op7_nearest_centroid
from quillspark.llm.minhash import op11_superminhash
from quillspark.llm.mpeg import op10_mpeg_audio
from quillspark.llm.ngram import op1_bloom_ngram
from quillspark.llm.packing import op9_island_packing
from quillspark.llm.periodic import op13_bit_planes
from quillspark.llm.secrets import op2_random_forest
from quillspark.llm.sharding import op3_virtual_slots
from quillspark.llm.simhash import op4_pigeonhole_simhash
from quillspark.llm.tokenfile import op5_context_mixing
from quillspark.llm.toxicity import op6_nn_pu
from quillspark.llm.whitening import op12_welford_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bloom_ngram": op1_bloom_ngram,
    "op2_random_forest": op2_random_forest,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_pigeonhole_simhash": op4_pigeonhole_simhash,
    "op5_context_mixing": op5_context_mixing,
    "op6_nn_pu": op6_nn_pu,
    "op7_nearest_centroid": op7_nearest_centroid,
    "op8_prefix_join": op8_prefix_join,
    "op9_island_packing": op9_island_packing,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_superminhash": op11_superminhash,
    "op12_welford_whitening": op12_welford_whitening,
    "op13_bit_planes": op13_bit_planes,
}

ORACLE_SQL: dict[str, str] = {}
