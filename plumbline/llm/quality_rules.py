"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Measures of a text are column expressions; a rule bounds a measure from below, above or both.
``compile_rules`` turns the table into a boolean and a list of broken rules. Nothing shuffles and
no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import own_columns

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so "
    "le la les de des du un une et en est que qui dans pour par sur au aux il elle pas ne se ce son avec plus "
    "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los las y del que una con no su para es lo como más pero sus al o este sí porque a"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure's least and greatest allowed value; either can be absent."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Broken if n_words < 50 or 100 * n_repeat_words > 50 * n_words.
BASE_RULES = (
    Rule("few words", "n_words", least=50),
    Rule("repeated words", "repeat_word_ratio", most=0.5),
)

#: The default table. Ratios of a text without words or lines are null, which breaks no rule.
RULES = (
    Rule("many words", "n_words", most=10_000_000),
    Rule("short words", "mean_word_chars", least=2.0),
    Rule("long words", "mean_word_chars", most=14.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("stop words", "stop_word_ratio", least=0.1),
    Rule("repeated lines", "dup_line_ratio", most=0.5),
)


def repeated_window_words(hashes: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words whose hash is in the array twice or more.

    Windows are sorted by hash with their positions, equal neighbours give the repeated positions,
    and, in order, each position covers the words up to the next one, ``width`` at most.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        twins = F.filter(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
        at = F.transform(F.array(F.sort_array(F.array_distinct(F.flatten(twins)))), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))))[0]
        return F.aggregate(at, F.lit(0).cast("long"), lambda total, x: total + x)

    repeated = F.transform(F.array(ordered), covered)[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeated)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``measures`` with the counts and ratios that rules can name.

    Hashes of three-word windows have 64 bits and are compared within one text only.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(value, F.lit(f"({WORD})"), F.lit(1)))
    out = out.withColumn("_lines", F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    out = out.withColumn("_hashes", F.transform(F.arrays_zip(*(F.slice("_words", i, n) for i in (1, 2, 3))), lambda x: F.xxhash64(x)))
    count = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all(value, F.lit(f"({SYMBOLS})"), F.lit(1))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_hashes"), 3),
    }
    out = out.withColumn("measures", F.struct(*(c.alias(k) for k, c in count.items())))
    m = lambda a, b: F.try_divide(F.col(f"measures.{a}").cast("double"), F.col(f"measures.{b}"))
    ratio = {
        "mean_word_chars": m("word_chars", "n_words"),
        "symbol_ratio": m("n_symbols", "n_words"),
        "stop_word_ratio": m("n_stop_words", "n_words"),
        "dup_line_ratio": m("n_dup_lines", "n_lines"),
        "repeat_word_ratio": m("n_repeat_words", "n_words"),
    }
    fields = [*(F.col(f"measures.{k}").alias(k) for k in count), *(c.alias(k) for k, c in ratio.items())]
    return out.withColumn("measures", F.struct(*fields)).drop("_words", "_lines", "_hashes")


def compile_rules(rules: tuple[Rule, ...], measures: str = "measures") -> Column:
    """The names of the rules that a row breaks, in the table's order."""

    def broken(rule: Rule) -> Column:
        x, bad = F.col(f"{measures}.{rule.measure}"), F.lit(False)
        if rule.least is not None:
            bad = bad | (x < rule.least)
        if rule.most is not None:
            bad = bad | (x > rule.most)
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Adds measures, base_failed, broken (names of broken rules, base ones first) and kept to ``docs``.

    A null or empty text has no words and so fails the base. Every row stays; null ids, repeated
    rows and further columns pass through, but for columns that are named like an added one, which
    are replaced.
    """
    added = ("measures", "base_failed", "broken", "kept")
    out = measured(_boxed(docs, text), "text")
    out = out.withColumn("base_failed", F.size(compile_rules(base)) > 0)
    out = out.withColumn("broken", compile_rules((*base, *rules))).withColumn("kept", F.size("broken") == 0)
    return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in added), *added)


def _boxed(docs: DataFrame, text: str) -> DataFrame:
    """All columns in one struct beside the text, so that no name clashes with one of the measures' steps."""
    return docs.select(F.struct(*own_columns(docs)).alias("doc"), F.col(f"`{text}`").alias("text"))


def only_kept(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, in their own columns.

    A row number stands between the measures and the filter. Without it the optimizer pushes the
    filter below the projection and copies the measures into it once for each rule.
    """
    out = measured(_boxed(docs, text), "text").withColumn("_row", F.monotonically_increasing_id())
    kept = out.filter((F.size(compile_rules((*base, *rules))) == 0) & (F.col("_row") >= 0))
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> str:
    """The query's rows in DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def holds(rule: Rule) -> str:
        bounds = [f"{rule.measure} >= {rule.least}"] if rule.least is not None else []
        bounds += [f"{rule.measure} <= {rule.most}"] if rule.most is not None else []
        return f"coalesce({' AND '.join(bounds)}, true)"

    both = lambda table: " AND ".join(map(holds, table))
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM texts),
    each AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM words),
    grams AS (SELECT r, i, [w, lead(w) OVER o, lead(w, 2) OVER o] AS g, lead(w, 2) OVER o AS last FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM grams WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    counts AS (
        SELECT r, doc_id, cast(len(words) AS bigint) AS n_words, cast(length(array_to_string(words, '')) AS bigint) AS word_chars,
            cast(len(regexp_extract_all(text, '{SYMBOLS}')) AS bigint) AS n_symbols, cast(len(list_filter(words, lambda w: rtrim(lower(w), '.,;:!?') IN ({stop}))) AS bigint) AS n_stop_words,
            cast(len(lines) AS bigint) AS n_lines, cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines
        FROM words),
    measures AS (
        SELECT *, cast(word_chars AS double) / nullif(n_words, 0) AS mean_word_chars, cast(n_symbols AS double) / nullif(n_words, 0) AS symbol_ratio, cast(n_stop_words AS double) / nullif(n_words, 0) AS stop_word_ratio,
            cast(n_dup_lines AS double) / nullif(n_lines, 0) AS dup_line_ratio, cast(n_repeat_words AS double) / nullif(n_words, 0) AS repeat_word_ratio
        FROM (SELECT counts.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM counts LEFT JOIN covered USING (r)))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({both(base)}) AS base_failed, ({both((*base, *rules))}) AS kept FROM measures"""
