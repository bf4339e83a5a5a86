"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose value exceeds a cutoff; a text is rejected if any rule of its stratum does. What is bounded
is the false rejection of that verdict: the share of good texts (labelled good, not failed by the base) that it rejects.

Labelled holdouts are parted in two halves by a hash of their id. The first half proposes: for each stratum and rule the
candidate cutoff that rejects most labelled bad texts, a good one counted ``WEIGHT`` times, and the rules in the order of
that gain. The second half, which had no say in this, tests: the first rule alone, then the first two together, and so
on. Of ``n`` good texts ``k`` are rejected by the rules so far; they are admitted only if the exact binomial bound says
that their false rejection is at most ``ALPHA``: P(X <= k | n, ALPHA) <= DELTA / strata (Bonferroni over the strata;
tests in a fixed order that ends with the first failure need no correction among themselves). So with probability 1 -
DELTA the verdict of every stratum keeps its promise. Counts are over all labelled rows. Everything is DataFrame
expressions; the binomial sum is taken from its largest term down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.llm.common import narrow, table

ALPHA, DELTA, WEIGHT = 0.05, 0.05, 10
STRATA = ("en", "de", "fr", "es")
#: Rule, value, candidate cutoffs.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1L)", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3)),
    ("marks", "n_marks / greatest(n_words, 1L)", (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1L)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    ("repeats", "n_repeat_words / greatest(n_words, 1L)", (0.02, 0.04, 0.06, 0.1, 0.14, 0.18)),
    ("long_words", "word_chars / greatest(n_words, 1L)", (6.0, 7.0, 8.0, 10.0, 12.0, 15.0)),
    ("short_words", "-(word_chars / greatest(n_words, 1L))", (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0)),
)


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """``_id`` and the measures of every row's whole text; a null text has no words.

    Windows of five words are compared by 64-bit hashes within their text. Only texts with an equal pair (found by a
    hash set) go on to sort their windows.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"), *extra)
    words = base.withColumn("_w", F.expr(r"filter(split(_t, '[ \\t-\\r]+', -1), x -> x <> '')")).withColumn(
        "_l", F.expr(r"filter(split(_t, '\n', -1), x -> x rlike '[^ \\t-\\r]')")
    )
    counted = words.select(
        "_id",
        *extra,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when size(_w) < 5 then array() else transform(sequence(0, size(_w) - 5), i -> xxhash64("
            "get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4))) end"
        ).alias("_h"),
    )
    marked = counted.withColumn("_again", F.expr("size(array_distinct(_h)) < size(_h)")).withColumn(
        "_s", F.expr("case when _again then sort_array(transform(_h, (x, i) -> struct(x as h, i as i))) end")
    )
    starts = marked.drop("_h").withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) or coalesce(get(_s, i + 1).h = x.h, false)), x -> x.i))"),
    )
    covered = F.expr(
        "aggregate(_p, named_struct('at', -5, 'n', 0L), (a, x) -> named_struct('at', x, 'n', a.n + least(5, x - a.at)), a -> a.n)"
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s", "_p", "_again")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _lgamma(x: str) -> str:
    """SQL for ln gamma(x), x > 0: Stirling's series at x + 8 (error below 1e-12)."""
    z = f"({x} + 8D)"
    return (
        f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5))"
        f" - ln({' * '.join(f'({x} + {k}D)' for k in range(8))}))"
    )


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial (n, p), for k < n p; 1 for larger k, where the bound can't hold.

    Terms fall from the k-th down; those more than 12 standard deviations below it add less than 1e-15 of the sum.
    """
    log_top = f"({_lgamma(f'({n} + 1D)')} - {_lgamma(f'({k} + 1D)')} - {_lgamma(f'({n} - {k} + 1D)')} + {k} * {math.log(p)!r}D + ({n} - {k}) * {math.log1p(-p)!r}D)"
    down = f"least(cast({k} as int), cast(ceil(12 * sqrt({n} * {p!r}D)) as int) + 60)"
    ratio = (1 - p) / p
    total = (
        f"aggregate(case when {down} < 1 then cast(array() as array<int>) else sequence(1, {down}) end, named_struct('t', 1D, 's', 1D), "
        f"(a, i) -> named_struct('t', a.t * ({k} - i + 1D) / ({n} - {k} + i) * {ratio!r}D, 's', a.s + a.t * ({k} - i + 1D) / ({n} - {k} + i) * {ratio!r}D), a -> a.s)"
    )
    return f"case when {k} >= {n} * {p!r}D then 1D else exp({log_top}) * {total} end"


def first_half(id_col: str) -> Column:
    """Whether a labelled row proposes cutoffs (else it tests them)."""
    return F.substring(F.md5(F.col(id_col).cast("string")), 1, 1) < "8"


def choose_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(stratum, n_rules, n, k, _c_<rule>..)``: the cutoffs admitted in a stratum, null for rules that aren't; no row without any.

    Labels other than 0 and 1 and null ids are left out; a row repeated in the labels counts once. Without labelled
    rows enough in a stratum no cutoff is admitted, and its rules reject nothing.
    """
    marked = narrow(labels, _lid=id_col, _y=label_col).where("_lid is not null and _y in (0, 1)").distinct()
    values = [F.expr(f"cast({v} as double)").alias(f"_v_{r}") for r, v, _ in RULES]
    held = staged(
        measured.where(~F.col("base_failed")).join(marked, F.col("_id") == F.col("_lid")).select("stratum", "_y", first_half("_id").alias("_first"), *values), "quality-held"
    )
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_v_{r}").alias("value"), F.array(*map(F.lit, c)).alias("cuts")) for r, _, c in RULES])
    long = held.where("_first").select("stratum", "_y", F.inline(rules)).select("stratum", "_y", "rule", "value", F.explode("cuts").alias("cutoff"))
    over = F.col("value") > F.col("cutoff")
    gain = (F.count_if(over & (F.col("_y") == 0)) - WEIGHT * F.count_if(over & (F.col("_y") == 1))).alias("gain")
    gains = long.groupBy("stratum", "rule", "cutoff").agg(gain).where("gain > 0")
    best = gains.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b")).select("stratum", "rule", "b.*")
    ordered = best.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("loss"), "rule", "cutoff"))).alias("rules"))  # six rules at most
    prefixes = ordered.select("stratum", "rules", F.explode(F.sequence(F.lit(1), F.size("rules"))).alias("n_rules")).select(
        "stratum", "n_rules", *[F.expr(f"get(filter(slice(rules, 1, n_rules), x -> x.rule = '{r}'), 0).cutoff").alias(f"_c_{r}") for r, *_ in RULES]
    )
    rejects = F.expr(" or ".join(f"coalesce(_v_{r} > _c_{r}, false)" for r, *_ in RULES))
    good = held.where("not _first and _y = 1").join(F.broadcast(prefixes), "stratum")  # five strata, six prefixes each at most
    counts = good.groupBy(*prefixes.columns).agg(F.count("*").alias("n"), F.count_if(rejects).alias("k"))
    admitted = counts.where(F.expr(binomial_tail("k", "n", ALPHA)) <= DELTA / (len(STRATA) + 1))
    cuts = [c for c in prefixes.columns if c.startswith("_c_")]
    last = F.max(F.struct("n_rules", "n", "k", *cuts)).alias("b")  # k doesn't fall from prefix to prefix, so those before it passed
    return admitted.groupBy("stratum").agg(last).select("stratum", "b.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures, ``base_failed`` and ``kept`` of every row.

    Null and blank texts have no words and fail the base. A null or unknown language is the stratum 'other'. Rows with
    null or repeated ids get a row each; an empty table gives no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_x"), F.col(f"`{lang_col}`").alias("_g"))
    stratum = F.when(F.col("_g").isin(*STRATA), F.col("_g")).otherwise("other")
    measured = staged(
        text_measures(own.withColumn("stratum", stratum), "_i", "_x", "stratum").withColumn("base_failed", base_failed()), "quality-measures"
    )
    met = measured.join(F.broadcast(choose_cutoffs(measured, labels, id_col).drop("n", "k", "n_rules")), "stratum", "left")  # five rows at most
    passed = F.expr(" and ".join(f"coalesce(cast({v} as double) <= _c_{r}, true)" for r, v, _ in RULES))
    return met.withColumn("kept", ~F.col("base_failed") & passed).withColumnRenamed("_id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    value = lambda v: v.replace("1L", "1")
    candidates = ", ".join(f"('{r}', {c!r}::DOUBLE)" for r, _, cs in RULES for c in cs)
    values = "CASE c.rule " + " ".join(f"WHEN '{r}' THEN ({value(v)})::DOUBLE" for r, v, _ in RULES) + " END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in STRATA)}) THEN lang ELSE 'other' END AS stratum
  FROM documents
), w AS (
  SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g), (SELECT unnest([0, 1, 2, 3, 4]) AS o)
  WHERE c >= 2 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
  FROM w LEFT JOIN r USING (doc_id)
), held AS (
  SELECT m.*, l.quality, left(md5(m.doc_id::VARCHAR), 1) < '8' AS first_half
  FROM m JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON m.doc_id = l.doc_id AND NOT m.base_failed AND l.quality IN (0, 1)
), gains AS (
  SELECT stratum, c.rule, c.cutoff, count(*) FILTER (WHERE quality = 0 AND {values} > c.cutoff) - {WEIGHT} * count(*) FILTER (WHERE quality = 1 AND {values} > c.cutoff) AS gain
  FROM held, (VALUES {candidates}) c(rule, cutoff) WHERE first_half GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) AS r FROM gains WHERE gain > 0) WHERE r = 1
), fate AS (
  SELECT h.stratum, h.doc_id, p.place AS n_rules, bool_or({values} > c.cutoff) AS rejected
  FROM held h JOIN ranked p ON p.stratum = h.stratum JOIN ranked c ON c.stratum = h.stratum AND c.place <= p.place
  WHERE NOT h.first_half AND h.quality = 1 GROUP BY ALL
), tests AS (
  SELECT stratum, n_rules, count(*) AS n, count(*) FILTER (WHERE rejected) AS k FROM fate GROUP BY ALL
), deployed AS (
  SELECT stratum, max(n_rules) AS n_rules FROM tests
  WHERE k < n * {ALPHA} AND list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})) for j in generate_series(0, k)]) <= {DELTA / (len(STRATA) + 1)!r}
  GROUP BY stratum
), rejected AS (
  SELECT DISTINCT m.doc_id FROM m JOIN deployed USING (stratum) JOIN ranked c ON c.stratum = m.stratum AND c.place <= n_rules WHERE {values} > c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM m
"""


OP9_SQL = _oracle()
