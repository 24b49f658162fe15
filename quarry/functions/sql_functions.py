"""The normalisers and scores as SQL functions of a session, for queries that are written as SQL.

They are SQL functions, which the analyser replaces by their bodies: no Python, and the optimiser sees through them. Names begin with quarry_.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.functions.text import NUMBER, SPACE
from quarry.functions.vocabulary import DIMENSIONS

PREFIX = "quarry_"


def _alias(dimension: str) -> str:
    words = DIMENSIONS[dimension]
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    found = rf"regexp_extract_all(quarry_normalize_text(x), r'(?U)\b(?:{'|'.join(words)})\b', 0)"
    first = f"array_min(transform({found}, w -> array_position(array({quoted(words)}), w)))"
    return f"coalesce(get(array({quoted(words.values())}), cast({first} AS INT) - 1), quarry_normalize_text(x))"


#: name -> (parameters, result, body), each after those that it uses.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "normalize_text": ("x STRING", "STRING", rf"nullif(trim(regexp_replace(translate(replace(lower(x), 'ß', 'ss'), concat('ёς', chr(160)), 'еσ '), r'{SPACE}', ' ')), '')"),
    "compact": ("x STRING", "STRING", r"nullif(regexp_replace(quarry_normalize_text(x), r'(?U)[\s\x1c-\x1f./\\_-]+', ''), '')"),
    "tokens": ("x STRING", "ARRAY<STRING>", r"regexp_extract_all(quarry_normalize_text(x), r'[\p{L}\p{N}_]+', 0)"),
    "dn": ("x STRING", "DOUBLE", rf"cast(nullif(regexp_extract(replace(quarry_normalize_text(x), ',', '.'), r'{NUMBER}', 0), '') AS DOUBLE)"),
    "pn_bar": ("x STRING", "DOUBLE", "CASE WHEN contains(quarry_normalize_text(x), 'мпа') OR contains(quarry_normalize_text(x), 'mpa') THEN quarry_dn(x) * 10 ELSE quarry_dn(x) END"),
    "length_mm": (
        "x STRING",
        "DOUBLE",
        r"""CASE WHEN contains(quarry_normalize_text(x), 'см') OR quarry_normalize_text(x) RLIKE r'(?U)\bcm\b' THEN quarry_dn(x) * 10
  WHEN (endswith(quarry_normalize_text(x), 'm') OR endswith(quarry_normalize_text(x), 'м')) AND NOT contains(quarry_normalize_text(x), 'мм') AND NOT endswith(quarry_normalize_text(x), 'mm') THEN quarry_dn(x) * 1000
  ELSE quarry_dn(x) END""",
    ),
    "number_text": (
        "v DOUBLE",
        "STRING",
        r"""CASE WHEN v IS NULL THEN NULL WHEN v = floor(v) AND abs(v) < 100000 THEN cast(floor(v) AS STRING) WHEN v = 0 THEN '0'
  ELSE regexp_replace(regexp_replace(format_string('%.6g', v), r'(\.[0-9]*?)0+(?=e|$)', '$1'), r'\.(?=e|$)', '') END""",
    ),
    **{d: ("x STRING", "STRING", _alias(d)) for d in DIMENSIONS},
    "rrf": ("place INT, k INT", "DOUBLE", "1.0D / (k + place)"),
    "idf": ("df BIGINT, n BIGINT", "DOUBLE", "log1p((n - df + 0.5D) / (df + 0.5D))"),
    "bm25": ("tf BIGINT, dl BIGINT, df BIGINT, n BIGINT, avgdl DOUBLE", "DOUBLE", "quarry_idf(df, n) * (tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / avgdl)))"),
    "dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN quarry_dot(a, a) > 0 AND quarry_dot(b, b) > 0 THEN quarry_dot(a, b) / (sqrt(quarry_dot(a, a)) * sqrt(quarry_dot(b, b))) ELSE 0D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; registering again replaces them. Returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [PREFIX + name for name in FUNCTIONS]
