"""URL filter: rules first, then a character language-model ratio, in built-in expressions only.

URLs that a rule decides train two smoothed variable-order Markov models, one for accepted and one
for rejected URLs; a share of them, HELD_OUT by their checksum, is kept apart. A model's contexts are
the ORDER - 1 characters before one, whatever characters they are, and each shorter context is what a
longer one backs off to (Witten-Bell), so an unseen one falls back to what has been seen of it. What
is counted grows with the pages: every character sequence of ORDER that occurs has a row, a whole
number of thousandths, the difference of both log-likelihoods. A URL's score is the mean over its
characters, and the threshold is where scores of accepted and rejected held-out URLs lie equally many
deviations from their means.

Counts are pre-aggregated before they are shuffled. Sequences like that of a scheme occur in all URLs:
the weights of those with a large share are broadcast, so that their rows never meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_counted, shared_folder, stored

#: Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Characters of the longest sequence, the least likelihood (one of the characters there may be).
ORDER, LEAST = 5, "1e0 / 65536"
#: First digits of a held-out URL's SHA-256.
HELD_OUT = "012"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for what is before a URL.
_BEFORE = "\x02"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its string; null if none does."""
    found = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.when(rule.isin(*(r for v, r in rules if v == "allow")), F.lit("allow")).when(rule.isNotNull(), F.lit("block"))


def held_out(url: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 1).isin(*HELD_OUT)


def sequences(url: Column) -> Column:
    """For each character it and the ORDER - 1 before it, as a string."""
    characters = F.regexp_extract_all(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), F.lit("(?s)(.)"), F.lit(1))

    def joined(x: Column) -> Column:
        out = x
        for k in range(1, ORDER):  # characters k places before
            earlier = F.slice(F.concat(F.array_repeat(F.lit(_BEFORE), k), x), F.lit(1), F.size(x))
            out = F.zip_with(earlier, out, lambda a, b: F.concat(a, b))
        return out

    return F.transform(F.array(characters), joined)[0]


def _probability(order: int, kind: str) -> str:
    """SQL of an interpolated likelihood from count c, its context's count s and distinct successors t."""
    shorter = LEAST if order == 1 else f"p{order - 1}_{kind}"
    c, s, t = (f"{x}{order}_{kind}" for x in "cst")
    return f"CASE WHEN coalesce({s}, 0) = 0 THEN {shorter} ELSE (coalesce({c}, 0) + {t} * ({shorter})) / ({s} + {t}) END"


def _weights_sql(counts: str, grid: str) -> str:
    """SQL from counts(g, c_a, c_r) of trained sequences to weights (g, w) for every g in grid."""
    steps = [f"n{ORDER} AS (SELECT g, c_a AS c{ORDER}_a, c_r AS c{ORDER}_r FROM {counts})"]
    for k in range(ORDER - 1, 0, -1):
        steps.append(f"n{k} AS (SELECT right(g, {k}) AS g, sum(c{k + 1}_a) AS c{k}_a, sum(c{k + 1}_r) AS c{k}_r FROM n{k + 1} GROUP BY 1)")
    for k in range(1, ORDER + 1):
        sums = ", ".join(f"sum(c{k}_{x}) AS s{k}_{x}, sum(CASE WHEN c{k}_{x} > 0 THEN 1 ELSE 0 END) AS t{k}_{x}" for x in "ar")
        steps.append(f"x{k} AS (SELECT left(g, {k - 1}) AS x, {sums} FROM n{k} GROUP BY 1)")
    before = grid
    for k in range(1, ORDER + 1):
        p = ", ".join(f"{_probability(k, x)} AS p{k}_{x}" for x in "ar")
        own = ", ".join(f"d.p{k - 1}_{x}" for x in "ar") if k > 1 else ""
        given = f"SELECT d.g, {own + ', ' if own else ''}{p} FROM {before} d LEFT JOIN x{k} ON x{k}.x = left(right(d.g, {k}), {k - 1}) LEFT JOIN n{k} ON n{k}.g = right(d.g, {k})"
        steps.append(f"o{k} AS ({given})")
        before = f"o{k}"
    return f"WITH {', '.join(steps)} SELECT g, cast(round(1000e0 * (ln(p{ORDER}_a) - ln(p{ORDER}_r))) AS bigint) AS w FROM o{ORDER}"


def fit(judged: DataFrame, folder: str) -> DataFrame:
    """Weights (g, w) of all sequences that occur, with how often (n), from those rows of ``judged(verdict, held, grams)`` that train.

    Without training rows every weight is 0.
    """
    one = lambda verdict: F.sum(F.when(F.col("trains") & (F.col("verdict") == verdict), 1).otherwise(0))
    trains = F.col("verdict").isNotNull() & ~F.col("held")
    counts = judged.select(trains.alias("trains"), "verdict", F.explode("grams").alias("g")).groupBy("g").agg(one("allow").alias("c_a"), one("block").alias("c_r"), F.count("*").alias("n"))
    counts = stored(counts, folder, "counts")
    weights = judged.sparkSession.sql(_weights_sql("{counts}", "{grid}"), counts=counts.filter("c_a + c_r > 0"), grid=counts.select("g"))
    return stored(weights.join(counts.select("g", "n"), "g"), folder, "weights")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judges every ``pages(page_id, url)``: page_id, host, path, rule, verdict and the score in thousandths.

    A null URL and one without ``://`` have empty host and path and fit no rule. An empty URL scores
    0. If accepted or rejected URLs are missing among those held out there is no threshold, and what
    no rule decides is allowed. Equal scores get equal verdicts; a score at the threshold is allowed.
    A URL of any length is scored whole. Null ids, repeated rows and an empty table pass through;
    other columns are not read.
    """
    folder = shared_folder(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("verdict", verdict_of(F.col("rule"), rules)).withColumn("held", held_out(F.col("url")))
    judged = stored(judged.withColumn("row", F.monotonically_increasing_id()), folder, "judged")
    with_grams = judged.withColumn("grams", sequences(F.col("url")))
    weights = fit(with_grams, folder)
    # a sequence such as that of https:// occurs in every URL: those with a large share are broadcast
    each = join_counted(with_grams.select("row", F.explode("grams").alias("g")), weights, "g")
    sums = each.groupBy("row").agg(F.sum("w").alias("w"), F.count("g").alias("n"))
    score = F.coalesce(F.floor(F.try_divide(F.col("w").cast("double"), F.col("n"))), F.lit(0)).cast("long")
    scored = stored(judged.join(sums, "row", "left").select("page_id", "host", "path", "rule", "verdict", "held", score.alias("score")), folder, "scored")
    s = F.col("score")
    of = lambda verdict: F.when(F.col("verdict") == verdict, s)
    marks = scored.filter("verdict IS NOT NULL AND held").agg(*(f(of(v)).alias(f"{name}_{v}") for v in ("allow", "block") for name, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))))
    threshold = marks.select(F.expr(_threshold_sql()).alias("threshold")).scalar()
    own = F.when(s < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce("verdict", own)).select("page_id", "host", "path", "rule", "verdict", "score")


def _threshold_sql() -> str:
    """Equal deviations from both means; between them if neither class varies."""
    mean = {v: f"(cast(s_{v} AS double) / nullif(n_{v}, 0))" for v in ("allow", "block")}
    sd = {v: f"sqrt(greatest(0e0, cast(q_{v} AS double) / nullif(n_{v}, 0) - {mean[v]} * {mean[v]}))" for v in mean}
    return f"CASE WHEN {sd['allow']} + {sd['block']} > 0 THEN ({mean['allow']} * {sd['block']} + {mean['block']} * {sd['allow']}) / ({sd['allow']} + {sd['block']}) ELSE ({mean['allow']} + {mean['block']}) / 2 END"


def oracle_sql(rules=RULES) -> str:
    """The same judgement in DuckDB SQL."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{own}' OR suffix(host, '.{own}')) AND prefix(path, '{slash}{rest}') THEN '{rule}'")
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules)
    one = lambda v: f"sum(CASE WHEN NOT held AND verdict = '{v}' THEN 1 ELSE 0 END)"
    parts = ", ".join(f"count(s) FILTER (verdict = '{v}') AS n_{v}, sum(s) FILTER (verdict = '{v}') AS s_{v}, sum(s * s) FILTER (verdict = '{v}') AS q_{v}" for v in ("allow", "block"))
    return f"""
    WITH urls AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
    parts AS (SELECT r, page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM urls),
    ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule, contains('{HELD_OUT}', left(sha256(url), 1)) AS held FROM parts),
    judged AS (SELECT *, CASE {verdicts} END AS verdict FROM ruled),
    letters AS (SELECT r, unnest(range(1, length(url) + 1)) AS i, repeat(chr(2), {ORDER - 1}) || translate(url, '{_UPPER}', '{_LOWER}') AS url FROM urls),
    grams AS (SELECT r, substring(url, i, {ORDER}) AS g FROM letters),
    counts AS (SELECT g, {one('allow')} AS c_a, {one('block')} AS c_r FROM grams JOIN judged USING (r) GROUP BY g),
    trained AS (SELECT * FROM counts WHERE c_a + c_r > 0),
    weights AS ({_weights_sql('trained', '(SELECT g FROM counts)')}),
    scores AS (SELECT r, cast(floor(cast(sum(w) AS double) / count(*)) AS bigint) AS s FROM grams JOIN weights USING (g) GROUP BY r),
    scored AS (SELECT judged.*, coalesce(s, 0) AS s FROM judged LEFT JOIN scores USING (r)),
    marks AS (SELECT {parts} FROM scored WHERE verdict IS NOT NULL AND held),
    mark AS (SELECT {_threshold_sql()} AS threshold FROM marks)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN s < (SELECT threshold FROM mark) THEN 'block' ELSE 'allow' END) AS verdict, s AS score FROM scored"""
