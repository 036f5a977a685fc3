"""The package's queries and their SQL."""

from __future__ import annotations

from . import licenses, lm, media, minhash, mixing, packing, pii, quality, secrets, warc

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_pii": pii.op2_pii,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_minhash": minhash.op4_minhash,
    "op5_licenses": licenses.op5_licenses,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_warc": warc.op7_warc,
    "op8_media": media.op8_media,
    "op9_secrets": secrets.op9_secrets,
    "op10_length_buckets": packing.op10_length_buckets,
}
ORACLE_SQL = {"op3_quality_rules": quality.ORACLE_SQL, "op4_minhash": minhash.ORACLE_SQL, "op6_mix_sources": mixing.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL}
