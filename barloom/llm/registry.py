"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import dedup, mixing, quality
from .dedup import op10_dedup
from .language import op7_language
from .lm import op5_lm
from .mixing import op2_mixing
from .neighbours import op9_neighbours
from .packing import op3_packing
from .pii import op1_pii
from .quality import op8_quality
from .secrets import op4_secrets
from .tokens import op6_tokens


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op1_pii": op1_pii, "op2_mixing": op2_mixing, "op3_packing": op3_packing, "op4_secrets": op4_secrets, "op5_lm": op5_lm, "op6_tokens": op6_tokens, "op7_language": op7_language, "op8_quality": op8_quality, "op9_neighbours": op9_neighbours, "op10_dedup": op10_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op8_quality": quality.SQL, "op10_dedup": dedup.SQL}
