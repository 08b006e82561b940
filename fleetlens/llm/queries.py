"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from fleetlens.llm import (centroids, chat, decontaminate, mixing, neighbours, packing, passages, pii, prefixes, quality, sharding,
                           simhash, toxicity)

QUERIES = {
    "op1_role_repair": chat.op1_role_repair,
    "op2_compact_windows": passages.op2_compact_windows,
    "op3_cross_polytope": neighbours.op3_cross_polytope,
    "op4_simhash_tiles": simhash.op4_simhash_tiles,
    "op5_template_windows": decontaminate.op5_template_windows,
    "op6_cotrained_quality": quality.op6_cotrained_quality,
    "op7_histogram_shards": sharding.op7_histogram_shards,
    "op8_weak_pii": pii.op8_weak_pii,
    "op9_poisson_mix": mixing.op9_poisson_mix,
    "op10_weak_toxicity": toxicity.op10_weak_toxicity,
    "op11_geometric_drift": centroids.op11_geometric_drift,
    "op12_tournament_packing": packing.op12_tournament_packing,
    "op13_truncation_peeling": prefixes.op13_truncation_peeling,
}

ORACLES = {
    "op5_template_windows": decontaminate.oracle(),
    "op9_poisson_mix": mixing.oracle(),
}
