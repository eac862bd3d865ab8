"""The operators' queries by registered name, and their SQL where SQL can express them."""

from sparkwright.llm import bpe, decontaminate, fingerprint, html_text, interpolation, merkle, minmax, pii, quality, repeats, simhash, warc, whitening

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_minhash": minmax.op3_minhash,
    "op4_quality": quality.op4_quality,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_repeats": repeats.op6_repeats,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_html": html_text.op9_html,
    "op10_interpolation": interpolation.op10_interpolation,
    "op11_merkle": merkle.op11_merkle,
    "op12_simhash": simhash.op12_simhash,
    "op13_whitening": whitening.op13_whitening,
}

SQL: dict[str, str] = {
    "op7_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
}
