"""Text functions as column expressions: folding, tokens, shingles, masks, scores."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fold_map() -> tuple[str, str]:
    """Precomposed letters and what is left of them without marks, from Unicode's decompositions."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(cp):
            src.append(chr(cp))
            dst.append(plain)
    return "".join([*src, "đĐ"]), "".join([*dst, "dD"])


_SRC, _DST = _fold_map()


def fold(col: Column | str) -> Column:
    """Lower case without accents, đ as d, blanks at the ends cut."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.lower(F.regexp_replace(F.translate(col, _SRC, _DST), r"\p{Mn}", "")))


def tokens(col: Column | str) -> Column:
    """Words of the folded text."""
    return F.regexp_extract_all(fold(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, k + 1, count).alias(f"w{k}") for k in range(n)])
    return F.transform(runs, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(both / either)


#: What stands behind stars in a search, in this order: numbers of 12 and 9 digits, mobile numbers, names of mail addresses, account numbers.
MASKS = (
    (r"\b(\d{3})\d{6}(\d{3})\b", r"$1******$2"),
    (r"\b(\d{3})\d{3}(\d{3})\b", r"$1***$2"),
    (r"\b(0[35789]\d)\d{4}(\d{3})\b", r"$1****$2"),
    (r"\b([A-Za-z0-9])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", r"$1***@$2"),
    (r"(STK|stk|tài khoản)(\W{0,3})(\d{4})\d{2,10}(\d{2})\b", r"$1$2$3****$4"),
)


def mask_pii(col: Column) -> Column:
    """A text as it is shown to those who may not see numbers and addresses whole."""
    for pattern, to in MASKS:
        col = F.regexp_replace(col, pattern, to)
    return col


def mask_name(col: Column) -> Column:
    """Each part of a name by its first letter and stars."""
    return F.array_join(F.transform(F.split(F.trim(col), r"\s+"), lambda w: F.concat(F.substring(w, 1, 1), F.lit("***"))), " ")


def quality(col: Column, base: float) -> Column:
    """A text's quality: the base less shares for suspicious characters and digit runs; short texts have 0.6."""
    odd = F.regexp_count(col, F.lit(r"[^\p{L}\p{N}\s.,;:!?()\-/]"))
    runs = F.regexp_count(col, F.lit(r"\d{5,}"))
    score = base - F.least(F.lit(0.15), 5.0 * odd / F.length(col)) - F.least(F.lit(0.05), 0.01 * runs)
    return F.when(F.length(col) < 10, 0.6).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def register(spark: SparkSession) -> None:
    """SQL functions: fold_text, word_tokens, mask_pii, mask_name, text_quality."""
    make = lambda name, kind, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    make("fold_text", "STRING", f"trim(lower(regexp_replace(translate(x, '{_SRC}', '{_DST}'), r'\\p{{Mn}}', '')))")
    make("word_tokens", "ARRAY<STRING>", r"regexp_extract_all(fold_text(x), r'[\p{L}\p{N}_]+', 0)")
    make("mask_name", "STRING", r"array_join(transform(split(trim(x), r'\s+'), w -> concat(substring(w, 1, 1), '***')), ' ')")
    masked = "x"
    for pattern, to in MASKS:
        masked = f"regexp_replace({masked}, r'{pattern}', '{to}')"
    make("mask_pii", "STRING", masked)
    odd, runs = r"regexp_count(x, r'[^\p{L}\p{N}\s.,;:!?()\-/]')", r"regexp_count(x, r'\d{5,}')"
    make("text_quality", "DOUBLE", f"CASE WHEN length(x) < 10 THEN 0.6D ELSE least(1.0D, greatest(0.0D, 0.92D - least(0.15D, 5.0D * {odd} / length(x)) - least(0.05D, 0.01D * {runs}))) END")
