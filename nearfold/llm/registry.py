"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from nearfold.llm.digest_index import OP1_SQL, op1_exact_dedup
from nearfold.llm.outliers import OP8_SQL, op8_quality_rules
from nearfold.llm.packing import op9_best_fit_packing
from nearfold.llm.pieces import op10_sentencepiece
from nearfold.llm.quality import op6_quality_classifier
from nearfold.llm.secrets import op4_secret_scan
from nearfold.llm.simhash import op7_simhash_near_dedup
from nearfold.llm.toxicity import op3_toxicity
from nearfold.llm.url_cascade import OP5_SQL, op5_url_filter
from nearfold.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_sentencepiece": op10_sentencepiece,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op5_url_filter": OP5_SQL, "op8_quality_rules": OP8_SQL}
