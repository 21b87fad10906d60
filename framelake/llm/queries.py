"""The corpus queries by name, and the DuckDB SQL of those that SQL can express."""

from . import alignment, decontaminate, gif, html, jaccard, language, mixing, pii, runs, sharding, toxicity, urlfilter, warc

QUERIES = {"op1_toxicity": toxicity.op1_toxicity, "op2_warc": warc.op2_warc, "op3_urlfilter": urlfilter.op3_urlfilter, "op4_sharding": sharding.op4_sharding, "op5_decontaminate": decontaminate.op5_decontaminate, "op6_mixing": mixing.op6_mixing, "op7_gif": gif.op7_gif, "op8_html": html.op8_html, "op9_language": language.op9_language, "op10_jaccard": jaccard.op10_jaccard, "op11_alignment": alignment.op11_alignment, "op12_runs": runs.op12_runs, "op13_pii": pii.op13_pii}
ORACLES: dict[str, str] = {"op2_warc": warc.OP2_SQL, "op3_urlfilter": urlfilter.OP3_SQL}
