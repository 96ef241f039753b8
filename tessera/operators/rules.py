"""Sentiment by rules over the order of words.

A lexicon word's weight depends on its neighbours: emphasis by capitals,
intensifiers and negators among the words before it, the side of a contrast
("but") on which it stands, and exclamation marks.  The rule tables are
parameters.

Each word is exploded beside the three words before it, so its context needs no
window and no shuffle: rows that are neither in the lexicon nor otherwise
needed are dropped in the same stage, and what is left of a chunk meets in one
aggregation.  A lexicon of a few thousand words is broadcast by the planner.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.labels import COMPOUND_ALPHA

#: Characters that are not part of a word at its ends.
PUNCTUATION = ".,;:!?\"'()[]{}<>*_~`«»“”„‘’…-"


@dataclass(frozen=True)
class Rules:
    """Rule tables and weights.  The numbers are those published for rule-based
    sentiment of short texts (fixed values); the word lists are English."""
    negators: tuple[str, ...] = ("no", "not", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot",
                                 "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "aren't", "weren't", "won't",
                                 "wouldn't", "shouldn't", "couldn't", "hasn't", "haven't", "hadn't", "without", "rarely", "seldom")
    stronger: tuple[str, ...] = ("very", "really", "extremely", "absolutely", "completely", "totally", "incredibly", "highly",
                                 "especially", "particularly", "remarkably", "deeply", "so", "most", "more", "quite")
    weaker: tuple[str, ...] = ("slightly", "somewhat", "barely", "hardly", "partly", "marginally", "almost", "less", "little", "occasionally")
    contrast: tuple[str, ...] = ("but",)
    boost: float = 0.293          # added by an intensifier next to the word
    fading: tuple[float, ...] = (1.0, 0.95, 0.9)  # of a boost one, two, three words before
    negation: float = -0.74       # factor of a negated weight
    capitals: float = 0.733       # added for a word in capitals in a text that is not
    before: float = 0.5           # factor before a contrast
    after: float = 1.5            # factor after it
    exclamation: float = 0.292    # added per exclamation mark
    exclamations: int = 4         # counted at most
    # Polarity: factors of the words just before, and of a negated polarity.
    more: float = 1.3
    fewer: float = 0.7
    reversal: float = -0.5
    alpha: float = field(default=COMPOUND_ALPHA)


def core(word: Column) -> Column:
    """A word in lower case without punctuation at its ends."""
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def _in(word: Column, listed: tuple[str, ...]) -> Column:
    return F.coalesce(word.isin(*listed), F.lit(False)) if listed else F.lit(False)


def _in_context(df: DataFrame, id_col: str, text_col: str, back: int) -> DataFrame:
    """(id, pos, w, p1 .. p<back>, plain): each word with the words before it;
    ``plain`` says that the text has a lower-case letter.  A text without words
    is one row of nulls."""
    ws = df.select(id_col, tx.words(text_col).alias("ws"), F.col(text_col).rlike(r"\p{Ll}").alias("plain"))
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), j), "ws") for j in range(1, back + 1)]
    zipped = F.slice(F.arrays_zip(F.col("ws").alias("w"), *[s.alias(f"p{j + 1}") for j, s in enumerate(shifted)]),
                     F.lit(1), F.size("ws"))
    rows = ws.select(id_col, "plain", F.posexplode_outer(zipped).alias("pos", "z"))
    return rows.select(id_col, "plain", "pos", *[F.col("z")[k].alias(n) for k, n in
                                                 [("w", "w")] + [(f"p{j}", f"p{j}") for j in range(1, back + 1)]])


def rule_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, rules: Rules = Rules(),
                   size: int = 300, cut: float = 0.05) -> DataFrame:
    """(id, score, label): chunks of ``size`` words scored by the rules, the
    mean of all chunks labelled with an inclusive cut-off.

    ``lexicon`` is (word, weight) in lower case.  A lexicon word w counts
    weight, plus ``capitals`` towards its sign if written in capitals, plus the
    fading boost of each intensifier among the three words before it (away from
    zero, or towards it for a weakening one), times ``negation`` if a negator is
    among them, times ``before`` or ``after`` by the side of the chunk's first
    contrast word.  The chunk's sum s moves away from zero by ``exclamation``
    per mark and becomes s / sqrt(s^2 + alpha).  Context never crosses a chunk.
    A text without words is neutral with score null; a chunk without lexicon
    words scores 0 and counts in the mean.  Rows of one id are one text only if
    ids are unique."""
    words = _in_context(df, id_col, text_col, 3).withColumn("core", core(F.col("w")))
    lex = lexicon.select(F.lower("word").alias("core"), F.col("weight").cast("double").alias("weight"))
    met = words.join(lex, "core", "left")
    contrast = _in(F.col("core"), rules.contrast)
    marks = F.length("w") - F.length(F.replace("w", F.lit("!"), F.lit("")))
    # The first word of a chunk is kept, so that every chunk has a row.
    met = met.where(F.col("pos").isNull() | F.col("weight").isNotNull() | contrast | F.col("w").contains("!") | (F.col("pos") % size == 0))
    sign = F.signum("weight")
    loud = F.col("plain") & (F.length("core") > 1) & (F.upper("w") == F.col("w")) & (F.lower("w") != F.col("w"))
    inside = [F.when(F.col("pos") % size >= j, core(F.col(f"p{j}"))) for j in (1, 2, 3)]
    boosts = [F.when(_in(p, rules.stronger), F.lit(rules.boost * f)).when(_in(p, rules.weaker), F.lit(-rules.boost * f)).otherwise(F.lit(0.0))
              for p, f in zip(inside, rules.fading)]
    value = F.col("weight") + sign * F.when(loud, F.lit(rules.capitals)).otherwise(F.lit(0.0)) + sign * reduce(Column.__add__, boosts)
    negated = reduce(Column.__or__, [_in(p, rules.negators) for p in inside])
    value = value * F.when(negated, F.lit(rules.negation)).otherwise(F.lit(1.0))
    at = F.col("pos") % size
    rows = met.select(id_col, F.floor(F.col("pos") / size).alias("chunk_no"), F.struct(at.alias("at"), value.alias("v")).alias("hit"),
                      F.col("weight").isNotNull().alias("counts"), F.when(contrast, at).alias("turn"), F.coalesce(marks, F.lit(0)).alias("marks"))
    chunks = rows.groupBy(id_col, "chunk_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("counts"), F.col("hit")))).alias("hits"),  # at most ``size`` of them, in order
        F.min("turn").alias("turn"), F.least(F.sum("marks"), F.lit(rules.exclamations)).alias("marks"))
    side = lambda h: F.when(h["at"] < F.col("turn"), F.lit(rules.before)).when(h["at"] > F.col("turn"), F.lit(rules.after)).otherwise(F.lit(1.0))
    s = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["v"] * side(h))
    chunks = chunks.select(id_col, "chunk_no", "marks", s.alias("s")).withColumn(
        "s", F.col("s") + F.signum("s") * F.col("marks") * F.lit(rules.exclamation))
    compound = F.when(F.col("chunk_no").isNotNull(), F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(rules.alpha)))
    out = chunks.groupBy(id_col).agg(F.avg(compound).alias("score"))
    return out.select(id_col, "score", F.when(F.col("score").isNull(), F.lit("neutral"))
                      .otherwise(tx.polarity_label("score", cut, inclusive=True)).alias("label"))


def rule_polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, rules: Rules = Rules(),
                  cut: float = 0.05) -> DataFrame:
    """(id, tb_polarity, tb_subjectivity, tb_sentiment): means over the lexicon
    words of a text, label with a strict cut-off.

    ``lexicon`` is (word, polarity, subjectivity).  The word just before, if an
    intensifier, multiplies both (within -1 to 1 and 0 to 1); a negator there,
    or before that intensifier, multiplies the polarity by ``reversal``.  No
    lexicon word, or no text, gives (0, 0, neutral)."""
    words = _in_context(df, id_col, text_col, 2).withColumn("core", core(F.col("w")))
    lex = lexicon.select(F.lower("word").alias("core"), F.col("polarity").cast("double").alias("polarity"),
                         F.col("subjectivity").cast("double").alias("subjectivity"), F.lit(True).alias("held"))
    met = words.join(lex, "core", "left").where("held OR pos IS NULL OR pos = 0")
    one, two = core(F.col("p1")), core(F.col("p2"))
    factor = F.when(_in(one, rules.stronger), F.lit(rules.more)).when(_in(one, rules.weaker), F.lit(rules.fewer)).otherwise(F.lit(1.0))
    negated = _in(one, rules.negators) | ((factor != 1.0) & _in(two, rules.negators))
    turn = F.when(negated, F.lit(rules.reversal)).otherwise(F.lit(1.0))
    one_to = lambda c, low: F.greatest(F.lit(low), F.least(F.lit(1.0), c))
    agg = met.select(id_col, (one_to(F.col("polarity") * factor, -1.0) * turn).alias("p"),
                     one_to(F.col("subjectivity") * factor, 0.0).alias("q"), "held").groupBy(id_col).agg(
        F.avg(F.when(F.col("held"), F.col("p"))).alias("p"), F.avg(F.when(F.col("held"), F.col("q"))).alias("q"))
    pol = F.coalesce("p", F.lit(0.0))
    return agg.select(id_col, pol.alias("tb_polarity"), F.coalesce("q", F.lit(0.0)).alias("tb_subjectivity"),
                      tx.polarity_label(pol, cut, inclusive=False).alias("tb_sentiment"))
