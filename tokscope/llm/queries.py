"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from . import chat_format, collocations, conversation_trie, license_scans, secret_scans
from .bpe import op1_bpe
from .chat_format import op12_chat_format
from .collocations import op11_collocations
from .conversation_trie import op13_conversation_trie
from .decontamination import op2_decontamination
from .jaccard_join import op4_jaccard_join
from .license_scans import op8_license_scans
from .quality_classifier import op7_quality_classifier
from .quality_rules import op5_quality_rules
from .secret_scans import op3_secret_scans
from .sharding import op9_sharding
from .substring_dedup import op6_substring_dedup
from .warc import op10_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scans": op3_secret_scans,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scans": op8_license_scans,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op3_secret_scans": secret_scans.ORACLE,
    "op8_license_scans": license_scans.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
