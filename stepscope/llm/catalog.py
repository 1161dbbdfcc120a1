"""The queries of the dealt operators and their SQL."""

from __future__ import annotations

from stepscope.llm.fingerprints import op9_fingerprints
from stepscope.llm.langid import op1_language_id
from stepscope.llm.packing import op6_best_fit_packing
from stepscope.llm.periodic import op11_periodic_runs
from stepscope.llm.phrases import OP12_SQL, op12_collocations
from stepscope.llm.pieces import op7_sentencepiece
from stepscope.llm.private import op13_private_spans
from stepscope.llm.quality import op2_quality_rules
from stepscope.llm.secrets import op10_secret_scan
from stepscope.llm.tiles import op8_simhash_tiles
from stepscope.llm.toxicity import op3_toxicity
from stepscope.llm.urls import op4_url_verdicts
from stepscope.llm.warc import OP5_SQL, op5_warc_normalise

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_warc_normalise": op5_warc_normalise,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_tiles": op8_simhash_tiles,
    "op9_fingerprints": op9_fingerprints,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_private_spans": op13_private_spans,
}
SQL = {"op5_warc_normalise": OP5_SQL, "op12_collocations": OP12_SQL}
