"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from hazgrid.llm import bpe, chat, codes, idfiles, infill, lengths, matroska, minhash, packing, quality, secrets, toxicity, windows


def queries():
    return {
        "op1_token_id_files": idfiles.op1_token_id_files,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_media_columns": matroska.op3_media_columns,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_token_counts": lengths.op7_token_counts,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_secret_scans": secrets.op9_secret_scans,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_packing": windows.op11_packing,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql():
    return {"op2_chat_formatting": chat.OP2_SQL, "op12_fill_in_middle": infill.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
