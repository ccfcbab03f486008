"""The registered queries of this subpackage, and the SQL that states some of them."""

from __future__ import annotations

from docproof.llm.fingerprints import op8_fingerprints
from docproof.llm.licenses import OP6_SQL, op6_licenses
from docproof.llm.mixing import OP9_SQL, op9_mixing
from docproof.llm.neighbours import op4_neighbours
from docproof.llm.packing import op10_packing
from docproof.llm.shingles import op5_shingles
from docproof.llm.substrings import op1_substrings
from docproof.llm.suffixes import op2_suffixes
from docproof.llm.token_store import op3_token_store
from docproof.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_suffixes": op2_suffixes,
    "op3_token_store": op3_token_store,
    "op4_neighbours": op4_neighbours,
    "op5_shingles": op5_shingles,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_licenses": OP6_SQL,
    "op9_mixing": OP9_SQL,
}
