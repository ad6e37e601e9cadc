"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, infilling, licenses, riskrules, spotsigs
from .bytecnn import byte_cnn_quality
from .centroids import centroid_langid
from .chosenpath import chosen_path_neardup
from .planes import bitplane_token_ids
from .sharding import balanced_propagation
from .tiling import string_tiling
from .transducer import bpe_transducer
from .warc import warc_chunks

QUERIES = {
    "op1_risk_controlled_rules": riskrules.risk_controlled_rules,
    "op2_bitplane_token_ids": bitplane_token_ids,
    "op3_license_scan": licenses.license_scan,
    "op4_chosen_path_neardup": chosen_path_neardup,
    "op5_bpe_transducer": bpe_transducer,
    "op6_warc_chunks": warc_chunks,
    "op7_byte_cnn_quality": byte_cnn_quality,
    "op8_balanced_propagation": balanced_propagation,
    "op9_centroid_langid": centroid_langid,
    "op10_string_tiling": string_tiling,
    "op11_fill_in_middle": infilling.fill_in_middle_query,
    "op12_filter_interactions": audit.filter_interactions,
    "op13_spot_signatures": spotsigs.spot_signatures,
}

SQL = {
    "op1_risk_controlled_rules": riskrules.SQL,
    "op3_license_scan": licenses.SQL,
    "op11_fill_in_middle": infilling.SQL,
    "op12_filter_interactions": audit.SQL,
    "op13_spot_signatures": spotsigs.SQL,
}
