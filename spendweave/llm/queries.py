"""Named queries of the corpus operators and the SQL that checks them, where SQL can express them."""
from . import (bpe, conversation_repair, exact_dedup, filter_audit, html_text, line_dedup, mixing, packing, quality_classifier, quality_rules, sharding, simhash,
               token_counts)


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bpe": bpe.op12_bpe,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_mixing": mixing.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
