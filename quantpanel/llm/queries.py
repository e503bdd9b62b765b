"""The registered queries of this subpackage."""

from __future__ import annotations

from . import alignment, ann, chat_format, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, packing, token_output, warc, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_packing": packing.op2_packing,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_language_id": language_id.op6_language_id,
        "op7_ann": ann.op7_ann,
        "op8_token_output": token_output.op8_token_output,
        "op9_warc": warc.op9_warc,
        "op10_mixing": mixing.op10_mixing,
        "op11_chat_format": chat_format.op11_chat_format,
        "op12_alignment": alignment.op12_alignment,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op4_license_scan": license_scan.OP4_SQL, "op9_warc": warc.OP9_SQL, "op10_mixing": mixing.OP10_SQL, "op11_chat_format": chat_format.OP11_SQL}
