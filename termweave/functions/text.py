"""Text expressions: grams, tokens, assertion classes, sentence pieces. All are Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "__empty__"

# The vocabularies of the assertion classes, in order of precedence.
ASSERTIONS = (
    ("family_history", "family history|mother|father|sister|brother|maternal|paternal"),
    ("negated", "no|not|denies|denied|without|negative for|never|no evidence of|free of"),
    ("uncertain", "possible|possibly|probable|suspected|suspect|query|question of|may have|might have|rule out|r/o"),
    ("historical_or_resolved", "history of|previous|previously|past history|resolved|remote history"),
)

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated a single time, also inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(c: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def nonempty(c: Column | str) -> Column:
    return F.when(trimmed(c) == "", EMPTY).otherwise(trimmed(c))


def collapsed(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(c), r"(?U)\s+", " "))


def char_grams(c: Column | str, low: int, high: int) -> Column:
    """Character n-grams inside each white-space token padded with a blank on both sides; a token shorter than n gives itself once."""
    tokens = F.filter(F.split(F.lower(col(c)), r"(?U)\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (n <= F.length(w) + 2))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 2 - n, F.lit(0)) + 1), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, n))))

    return F.flatten(F.transform(tokens, of))


def words(c: Column | str) -> Column:
    """Words of two or more word characters."""
    # Runs of word characters end where \b is; it would only be looked for twice more
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\w{2,}+"), F.lit(0))


def word_grams(c: Column | str) -> Column:
    """Words of two or more word characters, and pairs of neighbours."""
    w = words(c)
    # Over two slices, as an expression outside a lambda is not evaluated anew for each element
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) >= 2, F.concat(w, pairs)).otherwise(w)


def assertion(context: Column | str) -> Column:
    """The first class, in order of precedence, whose vocabulary occurs; `affirmed` if none does."""
    out = None
    for name, words in ASSERTIONS:
        hit = F.coalesce(col(context), F.lit("")).rlike(rf"(?iU)\b({words})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("affirmed")


def local_context(text: Column | str, start: Column | str, end: Column | str, window: int = 100) -> Column:
    """The words around [start, end): from the last full stop or line feed (at most `window` back) to the next one."""
    t, s, e = col(text), col(start), col(end)
    before = F.substring(t, F.greatest(s - window, F.lit(0)) + 1, F.least(s, F.lit(window)))
    tail = F.substring_index(F.substring_index(before, ".", -1), "\n", -1)
    mark = F.length(F.regexp_extract(F.substring(t, e + 1, F.length(t)), r"^[^.\n]*[.\n]", 0))
    ends = once(mark, lambda n: F.struct((s - F.length(tail)).alias("left"), F.when(n > 0, e + n).otherwise(F.least(F.length(t), e + window)).alias("right")))
    return once(ends, lambda p: trimmed(F.substring(t, p["left"] + 1, p["right"] - p["left"])))


def without_spans(text: Column | str, spans: Column | str) -> Column:
    """The text with the characters of the spans (struct of start and end) as blanks, so that offsets stay."""
    return F.aggregate(col(spans), col(text), lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
