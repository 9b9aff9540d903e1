"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .bpe import op2_bpe
from .langid import op1_langid
from .licenses import op7_licenses
from .lines import op9_lines
from .media import op6_media
from .mixing import SQL as MIXING_SQL
from .mixing import op4_mixing
from .ngram_join import op5_ngram_join
from .pii import op11_pii
from .quality import op3_quality
from .resample import op13_resample
from .spelling import op12_spelling
from .substring import op8_substring
from .topk import SQL as TOPK_SQL
from .topk import op10_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_media": op6_media,
    "op7_licenses": op7_licenses,
    "op8_substring": op8_substring,
    "op9_lines": op9_lines,
    "op10_topk": op10_topk,
    "op11_pii": op11_pii,
    "op12_spelling": op12_spelling,
    "op13_resample": op13_resample,
}
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": MIXING_SQL,
    "op5_ngram_join": sql.NGRAM_JOIN,
    "op8_substring": sql.SUBSTRING,
    "op9_lines": sql.LINES,
    "op10_topk": TOPK_SQL,
    "op12_spelling": sql.SPELLING,
    "op13_resample": sql.RESAMPLE,
}
