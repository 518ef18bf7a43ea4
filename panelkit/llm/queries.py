"""The corpus queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import contamination, mixing, ranked, search
from .contamination import op11_decontamination
from .language import op9_language
from .mixing import op7_mixing
from .near import op3_minhash
from .passages import op4_passages
from .periods import op13_periods
from .pieces import op2_sentencepiece
from .quality import op8_quality
from .ranked import op12_ranked
from .rollups import op1_token_counts
from .search import op10_search
from .secrets import op5_secrets
from .sketches import op6_fingerprints

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash": op3_minhash,
    "op4_passages": op4_passages,
    "op5_secrets": op5_secrets,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_search": op10_search,
    "op11_decontamination": op11_decontamination,
    "op12_ranked": op12_ranked,
    "op13_periods": op13_periods,
}

ORACLES: dict[str, str] = {
    "op7_mixing": mixing.SQL,
    "op10_search": search.SQL,
    "op11_decontamination": contamination.SQL,
    "op12_ranked": ranked.SQL,
}
