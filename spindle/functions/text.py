"""Column expressions for strings, token arrays and small math.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing is evaluated in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must be identical in every engine that checks our results)
# ---------------------------------------------------------------------------
# Text token pattern: letter runs, digit runs, or any single other non-space char.
TEXT_TOKEN_PATTERN = r"(\p{L}+|[0-9]+|[^\p{L}0-9\s])"
# Word pattern: letter runs only.
WORD_PATTERN = r"(\p{L}+)"
# Published SMILES atom-level token pattern (bracket atoms, two-letter halogens,
# organic subset, bonds, branches, ring closures).
SMILES_TOKEN_PATTERN = (
    r"(\[[^\]]+\]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9])"
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regex_tokens(text, pattern: str = TEXT_TOKEN_PATTERN, lower: bool = True) -> Column:
    """#80 ``tokenize_atomwise``: all matches of ``pattern`` (group 1) as an array."""
    t = _c(text)
    return all_matches(F.lower(t) if lower else t, pattern)


_OPEN, _CLOSE = "\x01", "\x02"


def all_matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` (group 1, never empty), in time linear in the text.

    ``regexp_extract_all`` copies the text for every match.  Here matches are
    wrapped in two control characters and the text is split around them; only
    a text that holds these characters itself takes the slow function.
    """
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$1{_CLOSE}")
    parts = F.array_remove(F.split(marked, f"(?:^|{_CLOSE})[^{_OPEN}{_CLOSE}]*+(?:{_OPEN}|$)", -1), "")
    odd = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(odd, F.regexp_extract_all(text, F.lit(pattern), 1)).otherwise(parts)


def text_tokens(text) -> Column:
    return regex_tokens(text, TEXT_TOKEN_PATTERN, True)


def word_tokens(text, lower: bool = True) -> Column:
    """Letter runs, by a split at what stands between them."""
    t = _c(text)
    return F.array_remove(F.split(F.lower(t) if lower else t, r"[^\p{L}]+", -1), "")


def smiles_tokens(text) -> Column:
    return regex_tokens(text, SMILES_TOKEN_PATTERN, False)


def kmer_tokens(tokens, k: int) -> Column:
    """#81 ``tokenize_kmer``: sliding windows of k tokens joined by ''.

    Built from k shifted slices combined with ``zip_with`` (no lambda refers
    to the whole array, so the token expression is evaluated k times per row,
    not once per window).  Rows shorter than k give an empty array.
    """
    t = _c(tokens)
    n = F.greatest(F.size(t) - F.lit(k) + 1, F.lit(0))
    out = F.slice(t, 1, n)
    for j in range(2, k + 1):
        out = F.zip_with(out, F.slice(t, j, n), lambda a, b: F.concat(a, b))
    return out


def split_delimited(text, sep: str = ",") -> Column:
    """#4 / #82: delimited string to array; empty string gives an empty array."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
        F.split(t, F.lit(sep) if len(sep) == 1 and sep not in r".$|()[{^?*+\\" else F.lit("\\" + sep))
    )


def join_tokens(tokens, sep: str = ",") -> Column:
    """#69 ``','.join`` / ``''.join``."""
    return F.array_join(_c(tokens), sep)


def strip_continuation(token) -> Column:
    """#70: drop leading whitespace and the ``##`` continuation marker."""
    return F.regexp_replace(F.ltrim(_c(token)), r"^##", "")


def strip_all_whitespace(text) -> Column:
    return F.regexp_replace(_c(text), r"\s+", "")


def tokens_to_string(tokens) -> Column:
    """#71: ``' '.join`` then glue ``##`` continuations to the previous piece."""
    return F.trim(F.replace(F.array_join(_c(tokens), " "), F.lit(" ##"), F.lit("")))


def parse_double_list(text) -> Column:
    """#73: stringified list of numbers to ``array<double>``."""
    return F.from_json(_c(text), "array<double>")


def softmax2(l0, l1):
    """#74: two-class softmax → (p0, p1), computed stably."""
    a, b = _c(l0), _c(l1)
    m = F.greatest(a, b)
    e0, e1 = F.exp(a - m), F.exp(b - m)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def logit(p) -> Column:
    """#75: ln(p / (1 - p))."""
    p = _c(p)
    return F.log(F.try_divide(p, F.lit(1.0) - p))


def l2_norm(arr) -> Column:
    """#76: Euclidean norm of an array<double>."""
    return F.sqrt(F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x * x))


def binarise(x) -> Column:
    """#78: 1 if x != 0 else 0."""
    return F.when(_c(x) != 0, F.lit(1)).otherwise(F.lit(0))


def perplexity(loss, n=None, batch=None) -> Column:
    """#79: exp(loss), exp(loss / n) or exp(loss * batch / n)."""
    v = _c(loss)
    if batch is not None:
        v = v * _c(batch)
    if n is not None:
        v = v / _c(n)
    return F.exp(v)


def md5_rank_key(seed, *cols) -> Column:
    """Deterministic, engine-independent pseudo-random order key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def md5_int(seed, *cols) -> Column:
    """First 32 bits of the md5 key as a non-negative bigint."""
    return F.conv(F.substring(md5_rank_key(seed, *cols), 1, 8), 16, 10).cast("bigint")
