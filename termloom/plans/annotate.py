"""The annotation of samples: from key-value pairs to terms and real-valued properties, as one plan over tables.

A ``Stage`` maps a :class:`State` of DataFrames to another; :func:`annotate` runs the usual stages in their usual
order, which matters. Nothing runs sample by sample. Tokens and matches are written once each, where many stages read
them. Rule tables that are left out do nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.functions import text as T
from termloom.functions.shared import shuffle_width, staged
from termloom.operators import graph as G, matching as M, relational as R, rules as U, tokens as K

PAIR = ["sample_id", "kv_key", "kv_value"]
#: Properties that take numbers, and the unit of those that have one by default.
PROPERTIES = {
    "EFO:0000246": "age", "EFO:0004918": "age at diagnosis", "EFO:0007061": "passage number", "EFO:0004343": "waist-hip ratio", "EFO:0004340": "body mass index",
    "EFO:0005056": "age at death", "EFO:0000724": "timepoint", "EFO:0000721": "time", "EFO:0000410": "disease staging",
}
DEFAULT_UNITS = {"EFO:0007061": "UO:0000189"}
#: Terms that follow from terms; texts of two characters; keys that license cell lines, and those of times.
CONSEQUENTS = {
    "EFO_BTO:0000214": ["CL:0000010"], "CL:0000010": ["EFO_BTO:0000214"], "EFO:0000579": ["EFO_BTO:0000214", "CL:0000010"],
    "EFO:0000322": ["EFO_BTO:0000214", "CL:0000010"], "EFO:0007061": ["EFO_BTO:0000214", "CL:0000010"], "EFO:0000616": ["DOID:14566"],
}
TWO_CHARACTERS = {"H9": ["CVCL:9773", "EFO:0003045"], "H7": ["CVCL:9772", "EFO:0005904"]}
CELL_LINE_KEYS = ("EFO:0000322", "EFO:0000324")
TIME_KEYS = ("EFO:0000721", "EFO:0000724")


@dataclass
class Rules:
    """Rule tables; ``None`` or empty: the stage does nothing."""

    filter_keys: list[str] = field(default_factory=list)
    filter_values: list[str] = field(default_factory=list)
    cell_line_keys: list[str] = field(default_factory=list)  # a second block list, for collections of cell lines
    cell_line_values: list[str] = field(default_factory=list)
    synonym_sets: DataFrame | None = None  # (set_id, member)
    cell_line_synonyms: DataFrame | None = None  # (set_id, member), a second table of sets
    acronyms: dict[str, list[str]] = field(default_factory=dict)
    lexicon: tuple[DataFrame, DataFrame] | None = None  # forms, variants
    property_sets: DataFrame | None = None  # (property_id, set_id, member)
    noun_phrases: list[str] = field(default_factory=list)
    superterm_links: DataFrame | None = None  # (term_id, linked_id)
    disease_links: DataFrame | None = None  # (term_id, implied_id)
    consequents: dict[str, list[str]] = field(default_factory=lambda: dict(CONSEQUENTS))
    two_characters: dict[str, list[str]] = field(default_factory=lambda: dict(TWO_CHARACTERS))
    combinations: tuple[DataFrame, DataFrame, DataFrame] | None = None  # needs_terms, needs_artifacts, (rule, term_id)
    facts: tuple[DataFrame, DataFrame] | None = None  # (fact_id, term_id), (fact_id, property_id, value, unit_id)
    properties: list[str] = field(default_factory=lambda: list(PROPERTIES))
    default_units: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_UNITS))
    delimiters: tuple[str, ...] = ("+", "_", "-", "/")


@dataclass
class Vocabulary:
    dictionary: DataFrame  # (s, term_id, target)
    edges: DataFrame  # (child, parent) of is_a and part_of
    mappable: DataFrame | None = None  # (term_id)
    fuzzy: DataFrame | None = None  # the dictionary of the fuzzy join, if another


@dataclass
class State:
    """Tables between stages. ``path`` is an array of (step, node): from the pair's side through tokens to the term."""

    spark: SparkSession
    kv: DataFrame
    vocabulary: Vocabulary
    rules: Rules
    tokens: DataFrame | None = None  # PAIR, side, tok, start, end, path
    matches: DataFrame | None = None  # PAIR, side, tok, start, end, path, term_id, label, edit_dist
    seen: DataFrame | None = None  # matches before any gave way: what inference starts from
    implied: DataFrame | None = None  # PAIR, side, root (the match that it follows from), path, term_id, consequent
    values: DataFrame | None = None  # PAIR, root, property_id, value, unit_id, consequent
    ancestors: DataFrame | None = None


def _rows(spark, pairs: dict[str, list[str]], schema: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, vs in pairs.items() for v in vs], schema)


def _step(name: str | Column, node: str) -> Column:
    """``path`` with one more step."""
    here = F.struct((F.lit(name) if isinstance(name, str) else name).alias("step"), F.col(node).alias("node"))
    return F.concat("path", F.array(here))


def _once(tokens: DataFrame) -> DataFrame:
    """One row a token, with its shortest path; ties by the path itself."""
    best = F.min(F.struct(F.size("path").alias("hops"), "path")).alias("_b")
    keys = [c for c in tokens.columns if c != "path"]
    return tokens.groupBy(*keys).agg(best).select(*keys, "_b.path")


def _grow(s: State, name: str, new: DataFrame) -> State:
    """Tokens with those of a generator, which carry the path of the token they are made of."""
    return replace(s, tokens=s.tokens.unionByName(new.withColumn("path", _step(name, "tok"))))


def filter_pairs(s: State) -> State:
    r = s.rules
    return replace(s, kv=K.block_pairs(s.kv, [*r.filter_keys, *r.cell_line_keys], [*r.filter_values, *r.cell_line_values]))


def start_tokens(s: State) -> State:
    first = F.array(F.struct(F.col("side").alias("step"), F.col("tok").alias("node")))
    return replace(s, tokens=K.init_tokens(s.kv.distinct()).withColumn("path", first))


def spread_tokens(s: State) -> State:
    """N-grams, lower case, delimiters, variants, synonyms and acronyms, each over all tokens so far; written once."""
    r = s.rules
    steps: list = [("n-gram", lambda t: K.ngrams(t)), ("lower case", lambda t: K.lowercase(t))]
    steps += [("delimiter " + x, lambda t, x=x: K.delimit(t, x)) for x in r.delimiters]
    if r.lexicon:
        steps += [(kind, lambda t, kind=kind: K.lexicon_variants(t, *r.lexicon, [kind])) for kind in ("inflection", "spelling")]
    if r.synonym_sets is not None:
        steps.append(("synonym", lambda t: K.expand_sets(t, r.synonym_sets)))
    if r.cell_line_synonyms is not None:
        steps.append(("synonym of a cell line", lambda t: K.expand_sets(t, r.cell_line_synonyms)))
    if r.acronyms:
        steps.append(("acronym", lambda t: K.expand_map(t, _rows(s.spark, r.acronyms, "from_str string, to_str string"))))
    for name, f in steps:
        s = _grow(s, name, f(s.tokens))
        s = replace(s, tokens=staged(_once(s.tokens), "tokens"))
    return s


def match_exactly(s: State) -> State:
    return replace(s, matches=_matched(s.tokens.join(M.exact_match(s.tokens, s.vocabulary.dictionary), "tok").withColumn("edit_dist", F.lit(0))))


def _matched(hits: DataFrame) -> DataFrame:
    return hits.withColumn("path", _step(F.col("label"), "term_id"))


def _key_terms(s: State) -> DataFrame:
    return s.matches.where("side = 'key'").select(*PAIR, "term_id").distinct()


def more_tokens(s: State) -> State:
    """Times with units for pairs with a time key, and synonyms of the key's property."""
    timed = _key_terms(s).where(F.col("term_id").isin(*TIME_KEYS)).select(*PAIR).distinct()
    grown = _grow(s, "time and unit", K.time_tokens(s.tokens.where("side = 'val'").join(timed, PAIR, "left_semi")))
    if s.rules.property_sets is not None:
        grown = _grow(grown, "synonym of the property", K.property_synonyms(s.tokens, _key_terms(s), s.rules.property_sets))
    return replace(s, tokens=staged(_once(grown.tokens), "tokens"))


def match_two_characters(s: State) -> State:
    two = _rows(s.spark, s.rules.two_characters, "s string, term_id string")
    new = s.tokens.join(two, s.tokens["tok"] == two["s"]).drop("s").withColumns({"label": F.lit("CUSTOM_TWO_CHAR_MATCH"), "edit_dist": F.lit(0)})
    return replace(s, matches=s.matches.unionByName(_matched(new)))


def match_nearly(s: State) -> State:
    d = s.vocabulary.fuzzy if s.vocabulary.fuzzy is not None else s.vocabulary.dictionary
    label = F.when(F.col("target") == "TERM_NAME", "TERM_NAME").otherwise(F.concat(F.lit("SYNONYM_"), "target"))
    hits = M.fuzzy_match(s.tokens, d).join(d, "s").select("tok", "term_id", label.alias("label"), "edit_dist").distinct()
    new = _matched(s.tokens.join(hits, "tok"))
    return replace(s, matches=staged(s.matches.unionByName(new).distinct(), "matches"))


def match_phrases(s: State) -> State:
    """Phrases that own their interval without being a term; they never come out."""
    if not s.rules.noun_phrases:
        return s
    new = s.tokens.where(F.col("tok").isin(*s.rules.noun_phrases)).withColumns({"term_id": F.concat(F.lit("PHRASE "), "tok"), "label": F.lit("PHRASE"), "edit_dist": F.lit(0)})
    return replace(s, matches=s.matches.unionByName(_matched(new)))


def block_cell_lines(s: State) -> State:
    special = s.matches.where("term_id like 'CVCL:%'").select("term_id").distinct()
    if s.rules.superterm_links is not None:
        special = special.unionByName(s.rules.superterm_links.where("term_id like 'CVCL:%'").select(F.col("linked_id").alias("term_id"))).distinct()
    ok = _key_terms(s).where(F.col("term_id").isin(*CELL_LINE_KEYS)).select(*PAIR)
    values, keys = s.matches.where("side = 'val'"), s.matches.where("side <> 'val'")
    left = staged(U.licensed(values, special, ok).select(*s.matches.columns).unionByName(keys), "matches")
    return replace(s, matches=left, seen=left.where("label <> 'PHRASE'"))


_ROOT = ("tok", "start", "end", "term_id", "label", "edit_dist")
_IMPLIED = (*PAIR, "side", "root", "path", "term_id", "consequent")


def _root() -> Column:
    return F.struct(*_ROOT)


def _nodes(s: State) -> DataFrame:
    """All terms of a sample so far, whatever gave way: PAIR, side, root, path, term_id."""
    out = (s.seen if s.seen is not None else s.matches).select(*PAIR, "side", _root().alias("root"), "path", "term_id")
    return out if s.implied is None else out.unionByName(s.implied.select(*out.columns))


def _alive(s: State, rows: DataFrame) -> DataFrame:
    """``rows`` whose root is still a match; those that follow from a value have none and stay."""
    left = s.matches.select(*PAIR, "side", _root().alias("root"))
    return rows.where("root is null").unionByName(rows.where("root is not null").join(left, [*PAIR, "side", "root"], "left_semi").select(*rows.columns))


def _infer(s: State, name: str, links: DataFrame, consequent: bool) -> State:
    """Terms that follow by ``links (term_id, implied_id)`` from those there are now."""
    met = _nodes(s).join(links.select("term_id", "implied_id").where("term_id <> implied_id").distinct(), "term_id")
    return _imply(s, name, met.withColumn("term_id", F.col("implied_id")), consequent)


def _imply(s: State, name: str, new: DataFrame, consequent: bool) -> State:
    """Rows of one root and term keep their shortest path, so what follows by several ways doesn't multiply."""
    new = _once(new.select(*PAIR, "side", "root", "term_id", _step(name, "term_id").alias("path"), F.lit(consequent).alias("consequent")))
    new = new.select(*_IMPLIED)
    return replace(s, implied=new if s.implied is None else s.implied.unionByName(new))


def follow_links(s: State) -> State:
    if s.rules.superterm_links is not None:
        s = _infer(s, "linked term of an ancestor", s.rules.superterm_links.withColumnRenamed("linked_id", "implied_id"), True)
    if s.rules.disease_links is not None:
        s = _infer(s, "disease of a cell line", s.rules.disease_links, False)
    return s


def drop_inner(s: State) -> State:
    s = replace(s, ancestors=s.ancestors if s.ancestors is not None else staged(G.closure_of_all(s.vocabulary.edges, s.matches.select("term_id").distinct()), "ancestors"))
    return replace(s, matches=staged(U.drop_contained(s.matches, s.ancestors), "matches"))


def follow_consequents(s: State) -> State:
    s = _infer(s, "consequence", _rows(s.spark, s.rules.consequents, "term_id string, implied_id string"), True)
    if s.rules.combinations:
        needs_terms, needs_artifacts, gives = s.rules.combinations
        here = _nodes(s)
        met = U.combinations(here.select("sample_id", "term_id").distinct(), s.tokens.select("sample_id", "tok").distinct(), needs_terms, needs_artifacts)
        giving = met.join(needs_terms, "rule").join(gives.withColumnRenamed("term_id", "implied_id"), "rule").select("sample_id", "term_id", "implied_id").where("term_id <> implied_id").distinct()
        s = _imply(s, "combination", here.join(giving, ["sample_id", "term_id"]).withColumn("term_id", F.col("implied_id")), False)
    return replace(s, implied=staged(s.implied, "implied"))


def extract_values(s: State) -> State:
    """Properties that a key reaches, numbers and units that its value does, by matches or what follows from them."""
    live = s.matches.select(*PAIR, "side", "term_id")
    if s.implied is not None:
        live = live.unionByName(_alive(s, s.implied).select(*live.columns))
    props = live.where(F.col("side") == "key").where(F.col("term_id").isin(*s.rules.properties)).select(*PAIR, F.col("term_id").alias("property_id")).distinct()
    values = s.tokens.where("side = 'val'").select(*PAIR, T.to_number(F.col("tok")).alias("value")).where("value is not null").distinct()
    units = live.where("side = 'val' and term_id like 'UO:%'").select(*PAIR, F.col("term_id").alias("unit_id")).distinct()
    default = s.spark.createDataFrame(list(s.rules.default_units.items()), "property_id string, default_unit string")
    found = U.real_values(props, values, units, default)
    none = F.lit(None).cast(s.matches.select(_root().alias("r")).schema["r"].dataType)
    return replace(s, values=staged(found.withColumns({"side": F.lit("val"), "root": none, "consequent": F.lit(False)}), "values"))


def prefer_direct(s: State) -> State:
    return replace(s, matches=U.direct_over_indirect(s.matches))


def follow_facts(s: State) -> State:
    """Facts of cell lines, then adults by age, facts among the ages, then the terms of every cell line."""
    if s.rules.facts:
        fact_terms, fact_values = s.rules.facts
        known = _nodes(s).where(F.startswith("term_id", F.lit("CVCL:")))
        more = known.join(fact_values.withColumnRenamed("fact_id", "term_id"), "term_id").withColumn("consequent", F.lit(True)).select(*s.values.columns).distinct()
        s = _infer(s, "fact of a cell line", fact_terms.select(F.col("fact_id").alias("term_id"), F.col("term_id").alias("implied_id")), True)
        s = replace(s, values=s.values.unionByName(more))
    here = F.concat_ws(" ", "property_id", "value", "unit_id").alias("node")
    rows = (*PAIR, "side", "root", "path")
    s = _imply(s, "adult by age", U.adult_terms(s.values.withColumn("path", F.array(F.struct(F.lit("value").alias("step"), here))), rows), True)
    return _imply(s, "cultured cell", U.namespace_terms(_nodes(s), rows), True)


def prefer_exact(s: State) -> State:
    return replace(s, matches=U.exact_over_fuzzy(s.matches))


#: A stage maps a state to another.
Stage = Callable[[State], State]

STAGES: tuple[Stage, ...] = (
    filter_pairs, start_tokens, spread_tokens, match_exactly, more_tokens, match_two_characters, match_nearly, match_phrases, block_cell_lines, follow_links,
    drop_inner, follow_consequents, extract_values, prefer_direct, follow_facts, prefer_exact,
)


def annotate(spark: SparkSession, kv: DataFrame, vocabulary: Vocabulary, rules: Rules | None = None, stages: tuple[Stage, ...] = STAGES) -> tuple[DataFrame, DataFrame]:
    """``mapped (sample_id, term_id, consequent, orig_key, orig_value, hops, path)`` and ``values (.., property_id, value, unit_id, consequent)``.

    Terms whose own match, or the match they follow from, is left at the end. The origin is the pair with the shortest
    path, ties by key, value and path. ``consequent``: all ways to the term are inferences that count as such.
    """
    s = State(spark, kv, vocabulary, rules or Rules())
    for stage in stages:
        s = stage(s)
    found = s.matches.where("label <> 'PHRASE'").select("sample_id", "term_id", F.lit(False).alias("consequent"), "kv_key", "kv_value", "path")
    if s.implied is not None:
        found = found.unionByName(_alive(s, s.implied).select(*found.columns))
    if vocabulary.mappable is not None:
        found = found.join(vocabulary.mappable, "term_id", "left_semi").select(*found.columns)
    best = F.min(F.struct(F.size("path").alias("hops"), "kv_key", "kv_value", "path")).alias("b")
    one = found.groupBy("sample_id", "term_id").agg(F.bool_and("consequent").alias("consequent"), best)
    mapped = one.select("sample_id", "term_id", "consequent", F.col("b.kv_key").alias("orig_key"), F.col("b.kv_value").alias("orig_value"), "b.hops", "b.path")
    values = _alive(s, s.values).select("sample_id", "property_id", "value", "unit_id", "consequent", F.col("kv_key").alias("orig_key"), F.col("kv_value").alias("orig_value"))
    return mapped, values.distinct()


def with_ancestors(mapped: DataFrame, edges: DataFrame) -> DataFrame:
    """``(sample_id, terms)``: sorted ids of the terms and all above them."""
    up = G.closure_of_all(edges, mapped.select("term_id").distinct())
    return mapped.join(up, "term_id").groupBy("sample_id").agg(F.sort_array(F.collect_set("ancestor")).alias("terms"))


#: Linked ids of a class that go side by side in one row, and terms that do, in the mean.
MEMBERS, TERMS = 256, 1000
#: Rows of either side, at most, that meet under one key of the last join; pairs of a task of it, in the mean.
SIDE, PAIRS = 8, 32_000_000


def link_tables(names: DataFrame, edges: DataFrame, a_space: str, b_space: str) -> DataFrame:
    """``(term_id, linked_id)`` between two id spaces by equal strings, handed down to all terms below.

    There are as many rows as pairs, which grow with the square of the terms that share a string. So strings are handed
    down instead of links, terms of a with the same strings are a class, and the last join alone writes out pairs: rows
    of about ``MEMBERS`` linked ids meet rows of about ``TERMS`` terms, and no pair is there twice, as each id is in one
    class. Written as Parquet, pairs in this order take few bytes: a task has few ids of either side, so dictionaries
    hold, a term comes in a run, and the linked ids come round again and again after a whole number of bytes, as their
    rows have multiples of eight ids, with those left over in rows of their own.
    """
    of = lambda space, c: names.where(F.startswith("term_id", F.lit(space + ":")) & F.col("target").isin("TERM_NAME", "EXACT")).select("s", F.col("term_id").alias(c)).where("s is not null")
    a, b = of(a_space, "linked_id"), of(b_space, "term_id")
    sets = staged(a.join(b.select("s"), "s", "left_semi").groupBy("linked_id").agg(F.sort_array(F.collect_set("s")).alias("strings")), "string-sets")
    classes = staged(sets.groupBy("strings").agg(F.min("linked_id").alias("class"), F.count("*").alias("n_linked")), "classes")
    by_string = classes.select(F.explode("strings").alias("mark"), "class")
    own = b.join(by_string.select(F.col("mark").alias("s")), "s", "left_semi").select("term_id", F.col("s").alias("mark"))
    below = G.handed_down(edges, own).join(names.select("term_id"), "term_id", "left_semi")
    asked = staged(below.join(by_string, "mark").select("term_id", "class").distinct(), "asked")
    sizes = classes.join(asked.groupBy("class").agg(F.count("*").alias("n_terms")), "class")
    lists, groups = "(n_{0} + {1} - 1) div {1}".format, "(({0} - 1) div {1}) + 1".format
    sizes = sizes.select("strings", "class", F.expr("n_linked * n_terms").alias("pairs"), F.expr(lists("linked", MEMBERS)).alias("chunks"), F.expr(lists("terms", TERMS)).alias("blocks"))
    sizes = staged(sizes.withColumns({"a_groups": F.expr(groups("chunks", SIDE)), "b_groups": F.expr(groups("blocks", SIDE))}), "sizes")
    key, pairs = ["class", "a_group", "b_group"], sizes.agg(F.sum("pairs")).first()[0] or 0
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    members = sets.join(sizes, "strings").groupBy("class", "b_groups", F.expr("pmod(xxhash64(linked_id), chunks)").alias("chunk")).agg(F.collect_list("linked_id").alias("l"))
    members = members.withColumn("whole", F.expr("size(l) - size(l) % 8")).withColumn("linked", F.explode(F.expr("filter(array(slice(l, 1, whole), slice(l, whole + 1, 8)), x -> size(x) > 0)")))
    members = members.select("class", F.expr(f"chunk div {SIDE}").alias("a_group"), each("b_groups").alias("b_group"), "linked")
    terms = asked.join(sizes, "class").groupBy("class", "a_groups", F.expr("pmod(xxhash64(term_id), blocks)").alias("block")).agg(F.collect_list("term_id").alias("terms"))
    terms = terms.select("class", each("a_groups").alias("a_group"), F.expr(f"block div {SIDE}").alias("b_group"), "terms")
    # By bytes these tables are small, so Spark would join them in a few tasks.
    n = max(-(-pairs // PAIRS), min(shuffle_width(names.sparkSession), -(-pairs // 1_000_000)), 1)
    # Generated code holds all that comes of one row; coalesce, to as many partitions, parts the steps, so that this is one list.
    met = terms.repartition(n, *key).join(members.repartition(n, *key), key).coalesce(n)
    return met.select(F.explode("terms").alias("term_id"), "linked").coalesce(n).select("term_id", F.explode("linked").alias("linked_id"))
