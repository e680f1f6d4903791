"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from spindrift.llm.decontaminate import op1_latent_decontamination
from spindrift.llm.license_scan import OP10_SQL, op10_license_scan
from spindrift.llm.line_chunks import op8_line_chunks
from spindrift.llm.ngram_lm import op4_ngram_trie
from spindrift.llm.packing import op5_best_fit_packing
from spindrift.llm.quality_rules import OP2_SQL, op2_host_quality
from spindrift.llm.simhash import op9_simhash
from spindrift.llm.token_counts import op7_token_counts
from spindrift.llm.warc import OP6_SQL, op6_warc
from spindrift.llm.weak_labels import op3_weak_label_quality


def queries() -> dict:
    return {
        "op1_latent_decontamination": op1_latent_decontamination,
        "op2_host_quality": op2_host_quality,
        "op3_weak_label_quality": op3_weak_label_quality,
        "op4_ngram_trie": op4_ngram_trie,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_warc": op6_warc,
        "op10_license_scan": op10_license_scan,
        "op7_token_counts": op7_token_counts,
        "op8_line_chunks": op8_line_chunks,
        "op9_simhash": op9_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_quality": OP2_SQL, "op6_warc": OP6_SQL, "op10_license_scan": OP10_SQL}
