"""Rules over matches: priority, containment, context, combinations, implied terms, real-valued properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Match labels that count as direct.
DIRECT = ("TERM_NAME", "EXACT_SYNONYM", "ENRICHED_SYNONYM")


def exact_over_fuzzy(matches: DataFrame) -> DataFrame:
    """Matches of an interval ``(sample_id, start, end)``: those with edits go where one has none."""
    low = F.min("edit_dist").over(Window.partitionBy("sample_id", "start", "end"))
    return matches.withColumn("_l", low).where("edit_dist = 0 or _l > 0").drop("_l")


def direct_over_indirect(matches: DataFrame) -> DataFrame:
    """Of a token's matches in one id space (the id's part before ``:``), indirect ones go where there is a direct one."""
    direct = F.col("label").isin(*DIRECT)
    space = F.split_part("term_id", F.lit(":"), F.lit(1))
    some = F.max(direct).over(Window.partitionBy("sample_id", "tok", "start", "end", space))
    return matches.withColumn("_d", some).where(direct | ~F.col("_d")).drop("_d")


def contained(intervals: DataFrame) -> DataFrame:
    """``(sample_id, start, end)`` of matched intervals that lie properly inside another of the same sample and side.

    A sweep instead of a self-join: with intervals in the order of start and falling end, one lies inside another if
    the furthest end before it reaches its own.
    """
    keys = [c for c in ("sample_id", "kv_key", "kv_value", "side") if c in intervals.columns]
    one = intervals.select(*keys, "start", "end").distinct()
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("_far", F.max("end").over(w)).where("_far >= end").drop("_far")


def _around(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Each interval ``(.., start, end)`` with every larger one ``(s2, e2)`` of its keys that holds it.

    An interval of length up to 2^k lies in at most two cells of that width, and one that holds another lies in the cell
    of the other's start. So they meet on (cell width, cell): candidates grow with the pairs that hold one another, not
    with the square of a value's matches.
    """
    level = F.expr("int(ceil(log2(greatest(`end` - start, 1))))")
    sized = intervals.withColumn("_k", level).withColumn("_top", F.max("_k").over(Window.partitionBy(*keys)))
    big = sized.select(*keys, "_k", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.expr("array_distinct(array(shiftright(start, _k), shiftright(greatest(`end` - 1, start), _k)))")).alias("_cell"))
    # sizes aren't estimated through explode: without the hint below many rows could be broadcast as few
    small = sized.select(*keys, "start", "end", F.explode(F.sequence("_k", "_top")).alias("_k")).withColumn("_cell", F.expr("shiftright(start, _k)"))
    met = small.hint("merge").join(big, [*keys, "_k", "_cell"]).where("s2 <= start and e2 >= `end` and (s2 < start or e2 > `end`)")
    return met.select(*keys, "start", "end", "s2", "e2")


def drop_contained(matches: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Matches whose interval isn't inside a larger matched one, or whose term is an ancestor of terms of all such intervals.

    ``ancestors (term_id, ancestor)``: without it no match inside another stays.
    """
    keys = [c for c in ("sample_id", "kv_key", "kv_value", "side") if c in matches.columns]
    at = [*keys, "start", "end"]
    inside = contained(matches)
    outer = matches.join(inside, at, "left_anti")
    if ancestors is None:
        return outer
    inner = matches.join(inside, at, "left_semi")
    around = _around(matches.select(*at).distinct(), keys).join(inside, at, "left_semi")
    n_around = around.groupBy(*at).agg(F.count("*").alias("_all"))
    reached = matches.select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), "term_id").distinct().join(ancestors, "term_id")
    reached = reached.select(*keys, "s2", "e2", F.col("ancestor").alias("term_id")).distinct()
    some = inner.select(*at, "term_id").distinct().join(around, at).join(reached, [*keys, "s2", "e2", "term_id"], "left_semi")
    all_of = some.groupBy(*at, "term_id").agg(F.count("*").alias("_some")).join(n_around, at).where("_some = _all")
    return outer.unionByName(inner.join(all_of, [*at, "term_id"], "left_semi").select(*matches.columns))


def licensed(matches: DataFrame, blocked_terms: DataFrame, license_pairs: DataFrame) -> DataFrame:
    """Matches but those of ``blocked_terms (term_id)`` that no licensed pair ``(sample_id, kv_key, kv_value)`` of the sample reaches."""
    ok = license_pairs.select("sample_id", "kv_key", "kv_value", F.lit(True).alias("_ok")).distinct()
    special = matches.join(blocked_terms, "term_id", "left_semi").join(ok, ["sample_id", "kv_key", "kv_value"], "left")
    bad = special.groupBy("sample_id", "term_id").agg(F.max(F.coalesce("_ok", F.lit(False))).alias("_ok")).where("not _ok")
    return matches.join(bad, ["sample_id", "term_id"], "left_anti")


def combinations(terms: DataFrame, artifacts: DataFrame, needs_terms: DataFrame, needs_artifacts: DataFrame) -> DataFrame:
    """``(sample_id, rule)`` of rules whose terms are all there, with one artifact at least of each of their sets.

    ``terms (sample_id, term_id)``, ``artifacts (sample_id, tok)``, ``needs_terms (rule, term_id)``,
    ``needs_artifacts (rule, set_no, tok)``. Relational division by counts.
    """
    need_t = needs_terms.groupBy("rule").agg(F.count_distinct("term_id").alias("nt"))
    need_a = needs_artifacts.groupBy("rule").agg(F.count_distinct("set_no").alias("na"))
    has_t = terms.join(needs_terms, "term_id").groupBy("sample_id", "rule").agg(F.count_distinct("term_id").alias("ht"))
    has_a = artifacts.join(needs_artifacts, "tok").groupBy("sample_id", "rule").agg(F.count_distinct("set_no").alias("ha"))
    met = has_t.join(need_t, "rule").where("ht = nt").join(need_a, "rule", "left").join(has_a, ["sample_id", "rule"], "left")
    return met.where("coalesce(ha, 0) = coalesce(na, 0)").select("sample_id", "rule")


def real_values(props: DataFrame, numbers: DataFrame, units: DataFrame, default_units: DataFrame) -> DataFrame:
    """``(sample_id, kv_key, kv_value, property_id, value, unit_id)`` for pairs whose key has exactly one property.

    ``props (.., property_id)``, ``numbers (.., value)``, ``units (.., unit_id)`` with the pair's columns; the unit is
    the only one, else the property's default, else 'missing'; with several units it is null.
    """
    pair = ["sample_id", "kv_key", "kv_value"]
    one = props.groupBy(*pair).agg(F.min("property_id").alias("property_id"), F.count_distinct("property_id").alias("n")).where("n = 1").drop("n")
    unit = units.groupBy(*pair).agg(F.min("unit_id").alias("u"), F.count_distinct("unit_id").alias("nu"))
    met = one.join(numbers.select(*pair, "value").distinct(), pair).join(unit, pair, "left").join(default_units, "property_id", "left")
    chosen = F.when(F.coalesce("nu", F.lit(0)) == 0, F.coalesce("default_unit", F.lit("missing"))).when(F.col("nu") == 1, F.col("u"))
    return met.select(*pair, "property_id", "value", chosen.alias("unit_id"))


def adult_terms(values: DataFrame, keep: tuple = ("sample_id",), age: str = "EFO:0000246", year: str = "UO:0000036", above: float = 18, terms: tuple = ("EFO:0001272", "UBERON:0007023")) -> DataFrame:
    """``(keep, term_id)``: terms of an adult for rows with an age in years above ``above``."""
    old = values.where((F.col("property_id") == age) & (F.col("unit_id") == year) & (F.col("value") > above))
    return old.select(*keep, F.explode(F.array(*map(F.lit, terms))).alias("term_id")).distinct()


def namespace_terms(terms: DataFrame, keep: tuple = ("sample_id",), prefix: str = "CVCL", give: tuple = ("CL:0000010", "EFO_BTO:0000214")) -> DataFrame:
    """``(keep, term_id)``: terms given for every term of the id space ``prefix``."""
    return terms.where(F.startswith("term_id", F.lit(prefix + ":"))).select(*keep, F.explode(F.array(*map(F.lit, give))).alias("term_id")).distinct()
