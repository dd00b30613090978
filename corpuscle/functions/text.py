"""Text functions as column expressions.

Four tokenisations live side by side because different rules need different ones:
blank_tokens (white space, punctuation kept), gate_tokens (apostrophes inside), word_tokens
(hyphens and apostrophes inside) and plan_tokens (runs of letters and digits without stop words).
All but normalise() stay in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)*"
GATE_TOKEN = "[a-z0-9]+(?:'[a-z0-9]+)?"
PLAN_TOKEN = "[a-z0-9]+"
SENTENCE_END = "[.!?;]+\\s+|\\n+"

#: Typographic punctuation and what it is compared as (fixed values).
FOLDED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body, or a function over array elements in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns, each worked out once a row: they pass a generator, behind which no later column can repeat how they were made."""
    return df.withColumn("_once", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))).select(*df.columns, "_once.*")


@F.pandas_udf(StringType())
def normalise(text: pd.Series) -> pd.Series:
    """NFKD, plain punctuation, single blanks, no blanks at the ends, case folded. Spark has no built-in for NFKD or case folding."""
    table = str.maketrans(FOLDED)
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKD", s).translate(table).split()).casefold())


def simple_normalise(text: Column) -> Column:
    """normalise() for text that needs no decomposition: lower case, plain punctuation, single blanks."""
    plain = F.translate(F.lower(text), "".join(FOLDED), "".join(FOLDED.values()))
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), "\\s+"), lambda t: t != "")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def word_tokens(normalised: Column) -> Column:
    return _found(normalised, WORD_TOKEN)


def gate_tokens(normalised: Column) -> Column:
    return _found(normalised, GATE_TOKEN)


def plan_tokens(text: Column, stop_words: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(stop_words)])
    return F.filter(_found(F.lower(text), PLAN_TOKEN), lambda t: ~F.array_contains(stop, t))


def word_count(normalised: Column) -> Column:
    return F.size(word_tokens(normalised))


def contains_verbatim(span: Column, quote: Column) -> Column:
    """The quote's tokens stand in the span's, in order and whole; false for an empty quote."""
    padded = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(quote) > 0) & F.contains(padded(span), padded(quote))


def lexical_overlap(claim: Column, span: Column) -> Column:
    """Share of the claim's tokens, repetitions counted, that the span holds; 0 for an empty claim."""
    hits = F.size(F.filter(claim, lambda t: F.array_contains(span, t)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(claim)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if there is none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def distinct_ratio(token_lists: Column, threshold: float) -> Column:
    """Share of the lists that are no near-copy of one kept before them; 1 for none. Order matters."""

    def ratio(lists: Column) -> Column:
        start = F.filter(lists, lambda _: F.lit(False))
        kept = F.aggregate(lists, start, lambda held, t: F.when(F.exists(held, lambda h: jaccard(h, t) >= threshold), held).otherwise(F.concat(held, F.array(t))))
        return F.coalesce(F.try_divide(F.size(kept).cast("double"), F.size(lists)), F.lit(1.0))

    return let(token_lists, ratio)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups, one at least."""
    return F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")), F.lit(1))


def long_word_share(tokens: Column) -> Column:
    """Share of words of three syllables or more; 0 for no words."""
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda w: syllables(w) >= 3)).cast("double"), F.size(tokens)), F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def tolerant_int(value: Column, default: int) -> Column:
    """A number in a string, cut to whole; the default where there is none."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(default))


def digits_only(value: Column) -> Column:
    """All digits of a string as one number: "10-12 minutes" is 1012; null without digits."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("long")


#: Closed-class negators (fixed values: what the rule recognises as a negation).
NEGATORS = (
    "no not never none nor neither nothing nobody cannot without cant can't dont don't doesnt doesn't didnt didn't isnt isn't arent aren't "
    "wasnt wasn't werent weren't wont won't wouldnt wouldn't shouldnt shouldn't couldnt couldn't hasnt hasn't havent haven't hadnt hadn't unlike unable"
).split()

#: Opposite sides of general polarity (fixed values).
OPPOSITES = (
    ("increase increases increased increasing rise rises rising rose grow grows", "decrease decreases decreased decreasing fall falls falling fell shrink shrinks"),
    ("more greater larger higher bigger longer stronger faster heavier maximum", "less fewer smaller lower shorter weaker slower lighter minimum"),
    ("positive positively", "negative negatively"),
    ("attract attracts attracted attraction attractive", "repel repels repelled repulsion repulsive"),
    ("same identical equal equals alike similar", "different differs differing unequal opposite"),
    ("above over up upward upwards", "below under down downward downwards"),
    ("before prior earlier preceding", "after later subsequent following"),
    ("directly direct proportional", "inversely inverse"),
    ("always all every", "sometimes some few"),
    ("possible possibly can", "impossible cannot"),
    ("gain gains gained", "lose loses lost"),
    ("true correct valid", "false incorrect invalid"),
)
SCOPE, CONTENT_LENGTH, LEAST_CONTENT, ECHO = 6, 4, 2, 0.75


def contradiction(claim: Column, span: Column) -> Column:
    """Why a claim (gate tokens) may say the opposite of its span: added_negation, polarity, dropped_negation or null.

    An added negation is a negator that the span lacks. Polarity: one text has one side of an
    opposition only, the other text the other side only. A dropped negation: an affirmative
    claim repeats three quarters of the content words (two at least) among the six tokens that follow
    one of the span's negators.
    """
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    negators = words(NEGATORS)
    added = F.exists(claim, lambda t: F.array_contains(negators, t) & ~F.array_contains(span, t))
    polarity = F.lit(False)
    for left, right in OPPOSITES:
        cl, cr, sl, sr = (F.arrays_overlap(t, words(side.split())) for t in (claim, span) for side in (left, right))
        polarity |= (cl & ~cr & sr & ~sl) | (cr & ~cl & sl & ~sr)
    after = lambda i: F.filter(F.slice(span, i + 2, SCOPE), lambda w: F.length(w) >= CONTENT_LENGTH)
    echoed = lambda c: (F.size(c) >= LEAST_CONTENT) & (F.size(F.filter(c, lambda w: F.array_contains(claim, w))) >= ECHO * F.size(c))
    marks = F.filter(F.transform(span, lambda t, i: F.when(F.array_contains(negators, t), i)), lambda i: i.isNotNull())
    dropped = ~F.arrays_overlap(claim, negators) & F.exists(marks, lambda i: echoed(after(i)))
    return F.when(added, "added_negation").when(polarity, "polarity").when(dropped, "dropped_negation")


def is_title_shaped(line: Column) -> Column:
    """Short, holds a word of two letters, does not begin in lower case, does not end like a sentence."""
    first = F.regexp_extract(line, "([\\p{L}\\p{N}_])", 1)
    return (
        line.rlike("\\p{L}{2,}") & (first != "") & ~first.rlike("^[a-z]$")
        & (F.size(blank_tokens(line)) <= 14) & ~line.rlike("[.!?;:,]\\s*$")
    )


NUMBERED = "^\\s*(?i:(chapter|section|unit|lesson|part)\\s+)?(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$"


def heading_level(line: Column, ratio: Column | None = None, bold: Column | None = None) -> Column:
    """Depth of a heading, null for body text: by numbering, else by type size relative to the body, else by bold."""
    title, number = F.regexp_extract(line, NUMBERED, 3), F.regexp_extract(line, NUMBERED, 2)
    depth = F.when(F.regexp_extract(line, NUMBERED, 1) != "", 1).otherwise(F.least(F.size(F.split(number, "\\.")), F.lit(6)))
    numbered = (title != "") & is_title_shaped(title)
    ratio = F.lit(None).cast("double") if ratio is None else ratio
    by_size = F.when(ratio >= 1.15 * 1.6, 1).when(ratio >= 1.15 * 1.3, 2).when(ratio >= 1.15, 3).when(F.coalesce(bold, F.lit(False)) if bold is not None else F.lit(False), 2)
    return F.when(numbered, depth).when(is_title_shaped(line), by_size)


MATH = "=≠≈≤≥±×÷∑∏∫√∞∂∇→←↔⇒⇔αβγδθλμπσωΔΩ^_"


def is_equation(line: Column) -> Column:
    """A line that reads as mathematics: LaTeX, or symbols without prose and either dense or short with an equals sign."""
    s = F.trim(line)
    symbols = F.length(s) - F.length(F.translate(s, MATH, ""))
    letters = F.regexp_count(s, F.lit("\\p{L}"))
    prose = F.regexp_count(F.lower(s), F.lit("\\b(the|is|are|and|of|to|in|that|this|which|when)\\b"))
    latex = s.startswith("$") | s.contains("\\frac") | s.contains("\\vec")
    dense = (symbols / F.greatest(letters, F.lit(1)) > 0.12) | ((F.size(blank_tokens(s)) <= 8) & s.contains("="))
    return (s != "") & (F.length(s) <= 220) & (latex | ((symbols > 0) & (prose < 2) & dense))


def band_of(score: Column, bounds: dict[str, float]) -> Column:
    """The first band, from the highest bound down, that the score reaches; null for null."""
    out = F.lit(None).cast("string")
    for name, least in sorted(bounds.items(), key=lambda x: x[1]):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
