"""Quality rules with risk-controlled thresholds.

Four rules look at four ratios of a document (symbols, repeated lines, repeated word triples, shouting). For each
rule and stratum (language) the cutoff is chosen from a fixed ladder. The labelled documents are dealt by a hash into a
selection half and a holdout half. On the holdout, the ladder is walked from lenient to strict: at each cutoff the exact
binomial tail P(X <= k | n, alpha) of k rejected among n good documents is a valid p-value of "false rejections exceed
alpha", and the walk stops at the first that isn't below delta (fixed-sequence testing: no price for the ladder's
length). delta is divided by the number of rules times strata (Bonferroni), and the stratum's false-rejection budget by
the number of rules (union bound), so with probability 1 - delta at most `alpha` of a stratum's good documents are
rejected, in all strata at once. Among the certified cutoffs the selection half picks the one with the best yield.

Everything is DataFrame expressions. Texts are read once; the features go to a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import SPACE, read, stored

ALPHA = 0.04
DELTA = 0.05
#: What one falsely rejected good document costs, in caught bad ones, when certified cutoffs are compared.
COST = 20
#: rule -> (numerator, denominator, ladder of cutoffs from lenient to strict); rejects ratios above the cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", [2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines", "n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "repeats": ("n_repeat_words", "n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "shouts": ("n_shouts", "n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
}


def bound(value: Column, use) -> Column:
    """use(v) with v evaluated once: a lambda's variable isn't computed anew for each element of an inner lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more, the first occurrence included."""

    def covered(grams: Column) -> Column:
        def twice(order: Column) -> Column:
            at = F.filter(order, lambda e, j: (e["g"] == F.get(order, j - 1)["g"]) | F.coalesce(e["g"] == F.get(order, j + 1)["g"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda e: F.array(e["p"], e["p"] + 1, e["p"] + 2)))))

        pairs = F.transform(grams, lambda g, p: F.struct(g.alias("g"), p.alias("p")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(bound(F.array_sort(pairs), twice))

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bound(hashed, lambda h: F.when(F.size(h) < 3, F.lit(0)).otherwise(bound(grams(h), covered)))


def features(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, lang and the counts that the rules use, of every whole text (null: empty); rows: and all columns of docs as
    the struct `row`, in the same pass."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    counted_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    row = [F.struct("*").alias("row")] if rows else []
    return docs.select(
        *row,
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        counted.alias("w"),
        counted_lines.alias("l"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"!!")).cast("long").alias("n_shouts"),
    ).select(*["row"] * rows, "doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_shouts")


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 1 by Stirling's series, shifted by 8 for small x; right to about 1e-13."""
    shift = x + 7
    product = F.log(x)
    for i in range(1, 7):
        product = product + F.log(x + i)
    inverse = 1 / shift
    square = inverse * inverse
    series = inverse * (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square * F.lit(1 / 1680))))
    return (shift - 0.5) * F.log(shift) - shift + F.lit(0.9189385332046727) + series - product


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, alpha), as 1 where k exceeds the mean (no evidence there).

    Below the mean the terms fall off faster than geometrically away from k, so those further than 40 standard
    deviations add less than a double can hold.
    """
    k, n = k.cast("double"), n.cast("double")
    least = F.greatest(F.lit(0), F.floor(k - 40 * F.sqrt(n * alpha) - 40)).cast("long")
    whole = log_gamma(n + 1)
    term = lambda i, whole: F.exp(whole - log_gamma(i + 1) - log_gamma(n - i + 1) + i * F.log(F.lit(alpha)) + (n - i) * F.log(F.lit(1 - alpha)))
    total = bound(whole, lambda c: F.aggregate(F.sequence(least, k.cast("long")), F.lit(0.0), lambda s, i: s + term(i.cast("double"), c)))
    return F.when(k <= n * alpha, F.least(total, F.lit(1.0))).otherwise(F.lit(1.0))


def stratum() -> Column:
    """The language, marked, so that none isn't the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over).cast("double") / F.col(under)).otherwise(F.lit(0.0))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """lang, rule, cutoff, n_good, n_false, p_value: the chosen cutoff of each rule and stratum that has one.

    labels: doc_id, quality (1 good, 0 bad; other rows don't count). No label, or too few for a proof: no cutoff.
    A document labelled twice counts once for each label.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1)).distinct()
    seen = feats.join(known, "doc_id").select(
        stratum().alias("stratum"),
        "quality",
        (F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) < "8").alias("holdout"),
        *[ratio(r).alias(r) for r in RULES],
    )
    # One pass and one row for each stratum: every ladder's counts are sums of conditions, combined before the shuffle.
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    sums = [F.count_if(good & F.col("holdout")).alias("n_good")]
    for rule, (_, _, ladder) in RULES.items():
        for i, cut in enumerate(ladder):
            over = F.col(rule) > cut
            sums += [F.count_if(good & F.col("holdout") & over).alias(f"{rule}_{i}_false"), (F.count_if(bad & ~F.col("holdout") & over) - COST * F.count_if(good & ~F.col("holdout") & over)).alias(f"{rule}_{i}_gain")]
    counts = seen.groupBy("stratum").agg(*sums)
    steps = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{i}_false").alias("n_false"), F.col(f"{rule}_{i}_gain").alias("gain"))
        for rule, (_, _, ladder) in RULES.items() for i, cut in enumerate(ladder)
    ])
    tests = counts.select("stratum", "n_good", F.explode(steps).alias("x")).select("stratum", "n_good", "x.*")
    tests = tests.withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), alpha / len(RULES)))
    n_strata = counts.agg(F.count("*")).scalar()
    passed = tests.withColumn("ok", F.col("p_value") <= delta / (len(RULES) * n_strata))
    walked = passed.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.collect_list(F.struct("gain", (-F.col("step")).alias("minus"), "step", "cutoff", "n_good", "n_false", "p_value")).alias("steps"))
    best = walked.withColumn("best", F.array_max(F.filter("steps", lambda s: (F.col("stop").isNull() | (s["step"] < F.col("stop"))) & (s["gain"] > 0))))
    return best.where(F.col("best").isNotNull()).select("stratum", "rule", "best.cutoff", "best.n_good", "best.n_false", "best.p_value")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rows: bool = False) -> DataFrame:
    """Features, base_failed, failed_rules (comma-joined) and kept for each row of docs; rows: and the row itself."""
    feats = stored(features(docs, rows), "quality-features")
    chosen = cutoffs(feats.drop("row"), labels, alpha, delta)
    # Stored, so that the planner knows its size: a few strata are broadcast, and very many are joined by shuffle.
    wide = stored(chosen.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]), "quality-cutoffs")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = feats.withColumn("stratum", stratum()).join(wide, "stratum", "left").withColumn("base_failed", base).withColumn("failed_rules", F.concat_ws(",", failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features, base_failed, failed_rules (comma-joined) and kept for each row of docs.

    Null text: an empty one, which fails the base. Null lang: a stratum of its own. Null doc_id: never labelled, but
    judged. Repeated rows are each judged. An empty table gives no rows. Other columns are ignored.
    """
    return judged(docs, labels, alpha, delta).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "base_failed", "failed_rules", "kept")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_shouts", "failed_rules")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the rules keep, each row judged by its own text. Rows go through the table of
    features with their text, so no text is shuffled."""
    return judged(docs, read(spark, sf_dir, "labels"), rows=True).where("kept").select("row.*")


_LADDERS = ", ".join(f"('{r}', {i}, {float(cut)!r}::DOUBLE)" for r, (_, _, ladder) in RULES.items() for i, cut in enumerate(ladder))
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT *, list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM w),
grams AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS p FROM g),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
f AS (SELECT g.doc_id, stratum, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts FROM g LEFT JOIN covered c ON g.doc_id = c.doc_id),
r AS (SELECT f.doc_id, stratum, rule, CASE WHEN b > 0 THEN a::DOUBLE / b ELSE 0 END AS ratio
  FROM f, LATERAL (VALUES {", ".join(f"('{r}', f.{a}, f.{b})" for r, (a, b, _) in RULES.items())}) AS x(rule, a, b)),
seen AS (SELECT r.*, quality, md5(doc_id::VARCHAR) < '8' AS holdout FROM r JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) USING (doc_id)),
ladder(rule, step, cutoff) AS (VALUES {_LADDERS}),
counts AS (SELECT stratum, rule, step, cutoff,
  count(*) FILTER (quality = 1 AND holdout) AS n, count(*) FILTER (quality = 1 AND holdout AND ratio > cutoff) AS k,
  count(*) FILTER (quality = 0 AND NOT holdout AND ratio > cutoff) - {COST} * count(*) FILTER (quality = 1 AND NOT holdout AND ratio > cutoff) AS gain
  FROM seen JOIN ladder USING (rule) GROUP BY ALL),
tests AS (SELECT *, CASE WHEN k <= n * {ALPHA / len(RULES)}::DOUBLE THEN least(1, list_sum(list_transform(range(0, k + 1), lambda i:
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)}::DOUBLE) + (n - i) * ln(1 - {ALPHA / len(RULES)}::DOUBLE))))) ELSE 1 END AS p FROM counts),
stops AS (SELECT stratum, rule, min(step) FILTER (p > {DELTA}::DOUBLE / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM seen))) AS stop FROM tests GROUP BY ALL),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (gain, -step)) AS cutoff FROM tests JOIN stops USING (stratum, rule)
  WHERE (stop IS NULL OR step < stop) AND gain > 0 GROUP BY ALL),
failed AS (SELECT doc_id, string_agg(rule, ',' ORDER BY {" ".join(["CASE rule", *[f"WHEN '{r}' THEN {i}" for i, r in enumerate(RULES)], "END"])}) AS failed_rules
  FROM r JOIN chosen USING (stratum, rule) WHERE ratio > cutoff GROUP BY doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept,
  n_shouts, coalesce(failed_rules, '') AS failed_rules FROM b LEFT JOIN failed USING (doc_id)
"""
