"""Text expressions: normalisation, edit alignment, distances.  All work per code point and stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with published scores to the character.
DIGITS = "零一二三四五六七八九"
UNITS = ["", "十", "百", "千", "万"]
PARTICLES = "啊啦吧呢哦哟哈嘛的了"
PUNCTUATION = "，。、？！?!,.；;：:\"'‘’（）()[]【】<>《》~·…—-_+=*/|@#$%^&{}"
COMMAND_PUNCTUATION = "，。、？！?!,. "

_STEP = 1 << 20


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars) + "]"


def full_to_half(x: Column) -> Column:
    """Full-width forms and the ideographic space to ASCII."""
    wide = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(x, wide, " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def num_to_zh(digits: Column) -> Column:
    """Reading of a run of ASCII digits: up to 99,999 as a number, beyond that digit by digit."""
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    n = F.length(plain)

    def place(i: Column) -> Column:
        c = F.substring(plain, i, F.lit(1))
        silent = (c == "1") & (n == 2) & (i == 1)
        return F.when(c == "0", "零").otherwise(F.concat(F.when(silent, "").otherwise(F.translate(c, "0123456789", DIGITS)), F.element_at(F.array(*map(F.lit, UNITS)), n - i + 1)))

    read = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(5))), place), ""), "零+", "零"), "零+$", "")
    by_digit = F.translate(digits, "0123456789", DIGITS)
    return F.when(n > 5, by_digit).when(n <= 1, F.translate(plain, "0123456789", DIGITS)).otherwise(read)


def numbers_to_zh(x: Column) -> Column:
    """Every run of digits in a text read out."""
    tokens = F.regexp_extract_all(x, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), num_to_zh(t)).otherwise(t)), "")


def normalize(x: Column) -> Column:
    """Half width, numbers read out, particles and punctuation dropped, lower case; null stays null.

    Numbers come before particles: the order is part of the result."""
    y = F.regexp_replace(numbers_to_zh(full_to_half(x)), _class(PARTICLES), "")
    return F.lower(F.regexp_replace(F.regexp_replace(y, _class(PUNCTUATION), ""), r"(?U)\s", ""))


def compact(x: Column) -> Column:
    """All white space removed; null becomes empty."""
    return F.coalesce(F.regexp_replace(x, r"(?U)\s", ""), F.lit(""))


def chars(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def alignment(ref: Column, hyp: Column) -> Column:
    """Struct (s, d, i, n, errors) of the best alignment: fewest errors, then fewest deletions and insertions.

    One number per cell holds both: a substitution costs 2**20, an insertion or deletion one more; so it is for texts
    whose distance is below 2**20.  Time grows with the product of lengths; see ``alignment_udf`` for long texts."""
    r, h = chars(ref), chars(hyp)
    n, m = F.length(ref).cast("long"), F.length(hyp).cast("long")
    gap = F.lit(_STEP + 1).cast("long")
    first = F.transform(F.sequence(F.lit(0), F.length(hyp)), lambda j: j.cast("long") * gap)

    def row(prev: Column, c: Column) -> Column:
        start = F.array(F.get(prev, F.lit(0)) + gap)

        def cell(acc: Column, j: Column) -> Column:
            match = F.when(F.get(h, j) == c, F.lit(0).cast("long")).otherwise(F.lit(_STEP).cast("long"))
            return F.array_append(acc, F.least(F.get(prev, j) + match, F.get(prev, j + 1) + gap, F.element_at(acc, -1) + gap))

        return F.when(F.length(hyp) > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(hyp) - 1, F.lit(0))), start, cell)).otherwise(start)

    v = F.element_at(F.aggregate(r, first, row), -1)
    errors, gaps = F.floor(v / _STEP).cast("long"), v % _STEP
    d = ((gaps + n - m) / 2).cast("long")
    return F.struct((errors - gaps).alias("s"), d.alias("d"), (gaps - d).alias("i"), n.alias("n"), errors.alias("errors"))


def alignment_udf():
    """The same for texts of any length: an Arrow UDF over distinct pairs, one vectorised row of the table at a time."""

    @F.pandas_udf("s long, d long, i long, n long, errors long")
    def run(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(ref, hyp, strict=True):
            if a is None or b is None:
                out.append((None,) * 5)
                continue
            x, y = (np.array([ord(c) for c in t], np.int64) for t in (a, b))
            step = np.arange(len(y) + 1, dtype=np.int64) * (_STEP + 1)
            now = step.copy()
            for k, c in enumerate(x, 1):
                best = np.empty_like(now)
                best[0] = k * (_STEP + 1)
                best[1:] = np.minimum(now[:-1] + np.where(y == c, 0, _STEP), now[1:] + _STEP + 1)
                now = np.minimum.accumulate(best - step) + step  # insertions run along the row
            errors, gaps = divmod(int(now[-1]), _STEP)
            d = (gaps + len(x) - len(y)) // 2
            out.append((errors - gaps, d, gaps - d, len(x), errors))
        return pd.DataFrame(out, columns=["s", "d", "i", "n", "errors"])

    return run


def cer(ref: Column, hyp: Column) -> Column:
    """Errors per reference character; raises for an empty or null reference."""
    checked = F.when(F.length(ref) > 0, ref).otherwise(F.raise_error(F.lit("empty reference text")).cast("string"))
    return F.levenshtein(checked, hyp) / F.length(checked)


def scaled_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def containment_distance(a: Column, b: Column) -> Column:
    """If one text contains the other only the lengths count; otherwise ``scaled_distance``.  An empty text is 1 away."""
    longer = F.greatest(F.length(a), F.length(b))
    held = F.contains(a, b) | F.contains(b, a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(1.0)).when(held, F.abs(F.length(a) - F.length(b)) / longer).otherwise(scaled_distance(a, b))


def corrected(hyp: Column, nearest: Column, distance: Column, most: Column | float) -> Column:
    """The nearest phrase if it is near enough and not empty."""
    return F.when((distance <= most) & (F.coalesce(nearest, F.lit("")) != ""), nearest).otherwise(hyp)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\p{Alnum}_-]", "_")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def general(x: Column) -> Column:
    """A number as %g writes it, for values of up to six significant digits."""
    text = F.format_string("%.6f", F.bround(x, 6))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def speaker_of(path: Column, pattern: str = r"(S\d{4})") -> Column:
    return F.regexp_extract(path, pattern, 1)


def syllables(x: Column, reading: dict[str, str]) -> Column:
    """Space-joined readings of characters (by a bounded dictionary); runs without one pass through whole."""
    if not reading:
        return x
    table = F.create_map(*[F.lit(v) for kv in sorted(reading.items()) for v in kv])
    known = "[" + "".join(sorted(reading)) + "]"
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"({known}|[^{known[1:-1]}]+)"), 1), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def unsafe_path(x: Column) -> Column:
    """Absolute, or climbing out of its root."""
    return x.rlike(r"^(/|\\|[A-Za-z]:)") | x.rlike(r"(^|[/\\])\.\.([/\\]|$)")
