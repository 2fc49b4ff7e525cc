"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in Spark expression over the text, every rule a row of
:data:`RULES`, and the verdict one boolean expression. There is no user function, no shuffle
and no second read.

Edge cases: a null text has no words; an empty text or one without words fails the base rule
(fewer than 10 words) and is not kept; the ratios of such a text are 0 and not null. Rows are
judged one by one, so repeated rows get equal results, ties cannot occur and an empty table
gives an empty result. Only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, let, table

# What separates words, which characters count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BULLET = r"^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on with as was by are this be from or it an at "
    "le la les de des du et un une en que qui est pour dans par sur pas au aux avec "
    "el los las del y se una con para es lo como al su por "
    "der die das und ist von mit den ein eine nicht zu auf im dem sich als auch für"
).split()


class Rule(NamedTuple):
    """A document passes if ``low <= measure <= high``; a bound of None is open.

    Rules with ``min_words`` look only at texts with that many words: shares in very short
    texts say nothing.
    """

    name: str
    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 10, 200_000),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("shouting", "upper_ratio", None, 0.5, 20),
    Rule("exclamations", "exclaim_ratio", None, 0.3, 20),
    Rule("stop_words", "stop_ratio", 0.02, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_ratio", None, 0.2),
    Rule("listing_lines", "bullet_ratio", None, 0.9, 50),
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a run of ``window`` words that occurs at least twice in ``words``.

    The runs are hashed first: if all hashes differ (the usual case) no run repeats, at the cost
    of one hash set of longs. Otherwise the runs themselves are sorted, equal neighbours marked
    and their lengths summed without counting an overlap twice; hashes decide nothing there.
    """
    def overlap(at: Column) -> Column:
        """Words covered by the runs that start at the sorted places ``at``."""
        return F.aggregate(
            F.transform(at, lambda x, i: F.least(
                F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
            F.lit(0), lambda a, b: a + b)

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(
            F.sequence(F.lit(0), F.size(w) - window),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("r"),
                               i.alias("i"))))
        starts = let(placed, lambda s: F.array_sort(F.filter(F.transform(
            s, lambda x, j: F.when(
                (F.get(s, j - 1)["r"] == x["r"]) | (F.get(s, j + 1)["r"] == x["r"]), x["i"])),
            lambda x: x.isNotNull())))
        return let(starts, overlap)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def count(w: Column) -> Column:
        return let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                   .otherwise(covered(w)))

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(count(w)))


def measures(df: DataFrame) -> DataFrame:
    """``doc_id`` and every measure, from a table of ``doc_id`` and ``text``."""
    text, bare = F.col("text"), F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.split(F.lower(F.regexp_replace(text, "[.,;:!?]+", "")), SPACE, -1)
    # The arrays are columns of their own, used by several measures each.
    base = df.select("doc_id", text, words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    some = F.greatest(n, F.lit(1))
    n_lines = F.greatest(F.size("_lines"), F.lit(1))
    word_chars = F.length(F.array_join("_words", ""))
    first = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        _count(text, "[" + SYMBOLS + "]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        (_count(text, "[A-Z]") / F.greatest(word_chars, F.lit(1))).alias("upper_ratio"),
        (_count(text, r"!!(?=[\x20\x09-\x0D]|\z)") / some).alias("exclaim_ratio"),
        (F.size(F.filter(plain, lambda x: x.isin(*sorted(set(STOP_WORDS))))) / some)
        .alias("stop_ratio"),
        (F.size(F.filter("_lines", lambda x: x.rlike(BULLET) | x.contains(" | ")))
         / n_lines).alias("bullet_ratio"),
        n_lines.alias("_n_lines"))
    at_least = F.greatest(F.col("n_words"), F.lit(1))
    return first.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "upper_ratio", "exclaim_ratio", "stop_ratio", "bullet_ratio",
        (F.col("word_chars") / at_least).alias("mean_word_chars"),
        (F.col("n_symbols") / at_least).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.col("_n_lines")).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / at_least).alias("repeat_ratio"))


def compile_rule(rule: Rule) -> Column:
    """True where the document passes ``rule``."""
    x, ok = F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        ok = ok & (x >= rule.low)
    if rule.high is not None:
        ok = ok & (x <= rule.high)
    return ok | (F.col("n_words") < rule.min_words) if rule.min_words else ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures, the names of the failed rules, ``base_failed`` and the verdict ``kept``."""
    judged = measures(id_and_text(docs, id_col, text_col))
    failed = F.filter(
        F.array(*[F.when(~compile_rule(r), F.lit(r.name)) for r in rules] or [F.lit(None)]),
        lambda x: x.isNotNull())
    return (judged.withColumn("failed_rules", failed.cast("array<string>"))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    bounds = [f"{rule.measure} >= {rule.low}" if rule.low is not None else "",
              f"{rule.measure} <= {rule.high}" if rule.high is not None else ""]
    ok = " AND ".join(filter(None, bounds)) or "true"
    return f"(({ok}) OR n_words < {rule.min_words})"


OP8_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
words AS (  -- one row a word, so that memory grows with the words and not with their square
  SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
windows AS (
  SELECT row, i, [{", ".join(f"lead(w, {k}) OVER following" for k in range(WINDOW))}] AS five
  FROM words WINDOW following AS (PARTITION BY row ORDER BY i)),
runs AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n
  FROM windows WHERE five[{WINDOW}] IS NOT NULL),
covered AS (
  SELECT row, count(DISTINCT place) AS n
  FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS place FROM runs WHERE n > 1) GROUP BY row),
counts AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, greatest(len(ls), 1) AS n_lines,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
         len(list_filter(ws, lambda w: ends_with(w, '!!'))) AS n_exclaim,
         len(list_filter(regexp_split_to_array(lower(regexp_replace(t, '[.,;:!?]+', '', 'g')),
                                               '[\x20\x09-\x0D]+'),
                         lambda w: w IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))})
             )) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '{BULLET}') OR contains(x, ' | '))) AS n_bullets
  FROM split LEFT JOIN covered USING (row)),
measures AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars,
         n_symbols / greatest(n_words, 1) AS symbol_ratio,
         n_upper / greatest(word_chars, 1) AS upper_ratio,
         n_exclaim / greatest(n_words, 1) AS exclaim_ratio,
         n_stop / greatest(n_words, 1) AS stop_ratio, n_dup_lines / n_lines AS dup_line_ratio,
         n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_bullets / n_lines AS bullet_ratio,
         n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_sql_rule, RULES))} AS kept
FROM measures
"""
