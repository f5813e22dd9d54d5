"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tracegraph.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from tracegraph.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from tracegraph.llm.html_text import op5_html_extraction
from tracegraph.llm.langid import op2_language_id
from tracegraph.llm.lattice import op9_lm_scoring
from tracegraph.llm.merkle import OP13_SQL, op13_merkle_manifest
from tracegraph.llm.mixing import OP3_SQL, op3_source_mixing
from tracegraph.llm.ngram_join import op1_ngram_jaccard_join
from tracegraph.llm.perplexity import op7_quality_rules
from tracegraph.llm.periodic_runs import op12_periodic_runs
from tracegraph.llm.quality import op4_quality_classifier
from tracegraph.llm.url_filter import OP8_SQL, op8_url_filters
from tracegraph.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_source_mixing, op4_quality_classifier, op5_html_extraction,
        op6_warc, op7_quality_rules, op8_url_filters, op9_lm_scoring, op10_benchmark_decontamination,
        op11_exact_dedup, op12_periodic_runs, op13_merkle_manifest,
    )
}

SQL = {"op3_source_mixing": OP3_SQL, "op6_warc": OP6_SQL, "op8_url_filters": OP8_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
