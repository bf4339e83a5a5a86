"""Rule tables, vocabulary slices and training sets from their JSON files.

Rule files are configuration that people write by hand, a few kilobytes each: the driver parses them whole, so of equal
keys the last counts. They are read by Spark all the same, so a path may be in any store. What setup programs make (links
of terms, facts of cell lines, mappings) is as large as a vocabulary or a corpus and is parsed by executors.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.operators import graph as G
from termloom.plans.annotate import Rules, Vocabulary
from termloom.sources import readers

#: The files' names.
FILES = {
    "filter": "filter_key_val_rules.json",
    "cell_line_filter": "cell_line_filter_key_val_rules.json",
    "synonyms": "custom_syn_sets.json",
    "cell_line_synonyms": "cvcl_syn_sets.json",
    "property_synonyms": "has_val_syn_term_ids.json",
    "acronyms": "acronym_to_expansions.json",
    "two_characters": "two_char_mappings.json",
    "phrases": "noun_phrases.json",
    "combinations": "term_artifact_combo.json",
    "consequents": "custom_term_to_consequent_terms.json",
    "properties": "real_valued_properties.json",
    "diseases": "cellline_to_disease_implied_terms.json",
    "superterms": "term_to_superterm_linked_terms.json",
    "facts": "cvcl_mappings.json",
}
#: The slices that tokens are matched with exactly and nearly, and those whose terms come out.
EXACT_SLICES = ("1", "2", "5", "7", "8", "9", "18")
FUZZY_SLICES = ("1", "2", "18", "5", "7", "9")
OUTPUT_SLICES = ("12", "1", "2", "16", "4")


def read_config(spark: SparkSession, path: str):
    """The value of a small JSON file."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def files_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the rule files that a folder or its subfolders hold, by kind; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(folder).select("path")
    names = {name: kind for kind, name in FILES.items()}
    at = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(*names))
    return {names[r["name"]]: r["path"] for r in at.orderBy(F.desc("path")).collect()}  # a row a rule file


def read_links(spark: SparkSession, path: str, to: str) -> DataFrame:
    """``(term_id, to)`` of JSON like term -> list of terms."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("term_id", "v")).select("term_id", F.explode("v").alias(to)).distinct()


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(fact_id, term_id)`` and ``(fact_id, property_id, value, unit_id)`` of JSON like cell line -> terms and values."""
    shape = "map<string,struct<mapped_terms:array<string>,real_value_properties:array<array<string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m")).select(F.explode("m").alias("fact_id", "v"))
    values = raw.select("fact_id", F.explode("v.real_value_properties").alias("p"))
    values = values.select("fact_id", F.get("p", F.lit(0)).alias("property_id"), F.get("p", F.lit(1)).try_cast("double").alias("value"), F.get("p", F.lit(2)).alias("unit_id"))
    return raw.select("fact_id", F.explode("v.mapped_terms").alias("term_id")).distinct(), values.distinct()


def _sets(listed: list) -> list[list[str]]:
    """A list of sets; a flat list is one set."""
    return listed if all(isinstance(x, list) for x in listed) else [[x for x in listed if isinstance(x, str)], *[x for x in listed if isinstance(x, list)]]


def read_rules(spark: SparkSession, files: dict[str, str] | str) -> Rules:
    """Rules from ``files`` by kind (see ``FILES``) or from a folder; a kind without a file keeps its default."""
    at = files_in(spark, files) if isinstance(files, str) else files
    get = lambda kind: read_config(spark, at[kind]) if kind in at else None
    out = Rules()
    if (x := get("filter")) is not None:
        out.filter_keys, out.filter_values = x.get("filter_keys", []), sorted(set(x.get("filter_values", [])))
    if (x := get("cell_line_filter")) is not None:
        out.cell_line_keys, out.cell_line_values = x.get("filter_keys", []), sorted(set(x.get("filter_values", [])))
    sets = lambda x: spark.createDataFrame([(i, m) for i, one in enumerate(x) for m in one], "set_id int, member string")
    if (x := get("synonyms")) is not None:
        out.synonym_sets = sets(x)
    if (x := get("cell_line_synonyms")) is not None:
        out.cell_line_synonyms = sets(x)
    if (x := get("property_synonyms")) is not None:
        out.property_sets = spark.createDataFrame([(p, i, m) for p, sets in x.items() for i, one in enumerate(_sets(sets)) for m in one], "property_id string, set_id int, member string")
    out.acronyms = get("acronyms") or out.acronyms
    out.two_characters = get("two_characters") or out.two_characters
    out.noun_phrases = get("phrases") or out.noun_phrases
    out.consequents = get("consequents") or out.consequents
    if (x := get("combinations")) is not None:
        need = lambda rows, shape: spark.createDataFrame(rows, shape)
        out.combinations = (
            need([(i, t) for i, r in enumerate(x) for t in r["required_terms"]], "rule int, term_id string"),
            need([(i, k, a) for i, r in enumerate(x) for k, one in enumerate(r["required_artifacts"]) for a in one], "rule int, set_no int, tok string"),
            need([(i, r["consequent_term"]) for i, r in enumerate(x)], "rule int, term_id string"),
        )
    if (x := get("properties")) is not None:
        out.properties, out.default_units = list(x["property_term_ids"]), x.get("default_units", {})
    if "superterms" in at:
        out.superterm_links = staged(read_links(spark, at["superterms"], "linked_id"), "superterms")
    if "diseases" in at:
        out.disease_links = staged(read_links(spark, at["diseases"], "implied_id"), "diseases")
    if "facts" in at:
        out.facts = read_facts(spark, at["facts"])
    return out


def removed_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``(term_id, s)`` of JSON like term -> name and ``exclude_synonyms``."""
    rows = [(t, s) for t, x in read_config(spark, path).items() for s in x["exclude_synonyms"]]
    return spark.createDataFrame(rows, "term_id string, s string")


class Slices:
    """Vocabulary slices by a configuration: slice -> projects, id spaces, roots of the subgraph, excluded terms.

    ``files`` gives the OBO file of each project; projects without one are left out. A slice is parsed and written once.
    """

    def __init__(self, spark: SparkSession, config: str, files: dict[str, str], extra: DataFrame | None = None, removed: DataFrame | None = None):
        self.spark, self.config, self.files = spark, read_config(spark, config), files
        self.extra, self.removed = extra, removed  # (term_id, s) both
        self._made: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}

    def tables(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``dictionary (s, term_id, target)``, ``edges (child, parent)`` and ``mappable (term_id)`` of a slice."""
        if name in self._made:
            return self._made[name]
        c = self.config[name]
        here = [p for p in c["included_ontology_projects"] if p in self.files]
        if not here:
            raise ValueError(f"no file for any project of slice {name}")
        obos = [readers.read_obo(self.spark, self.files[p], p, list(c["id_spaces"] or []) or None) for p in here]
        whole = {k: reduce(DataFrame.unionByName, [o[k] for o in obos]) for k in ("term", "synonym", "rel")}
        term, rel = staged(whole["term"].select("term_id").distinct(), "slice-terms"), staged(whole["rel"], "slice-edges")
        names = readers.dictionary(whole)
        if self.extra is not None:
            names = names.unionByName(self.extra.select("s", "term_id", F.lit("ENRICHED").alias("target")))
        if self.removed is not None:  # names stay
            gone = self.removed.select("term_id", "s").distinct().withColumn("_gone", F.lit(True))
            names = names.join(gone, ["term_id", "s"], "left").where("_gone is null or target = 'TERM_NAME'").select("s", "term_id", "target")
        if c["restrict_to_specific_subgraph"]:
            roots = self.spark.createDataFrame([(r,) for r in c["subgraph_roots"]], "term_id string")
            term = G.subtree(rel.where("rel = 'is_a'").select("child", "parent"), roots.join(term, "term_id", "left_semi")).join(term, "term_id", "left_semi")
            rel = G.restrict(rel, term)
        names = names.join(term, "term_id", "left_semi").select("s", "term_id", "target").distinct()
        mappable = term.where(~F.col("term_id").isin(*c["exclude_terms"])) if c["exclude_terms"] else term
        self._made[name] = (
            staged(names, "slice-names"), staged(rel.where("rel in ('is_a', 'part_of')").select("child", "parent").distinct(), "slice-edges"), staged(mappable, "slice-mappable")
        )
        return self._made[name]

    def _united(self, names: tuple[str, ...], which: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.tables(n)[which] for n in names]).distinct()

    def vocabulary(self, exact: tuple[str, ...] = EXACT_SLICES, fuzzy: tuple[str, ...] = FUZZY_SLICES, output: tuple[str, ...] = OUTPUT_SLICES) -> Vocabulary:
        """Exact matches are with mappable terms, near ones with all; the slices in ``output`` give the edges and what comes out."""
        strict = reduce(DataFrame.unionByName, [self.tables(n)[0].join(self.tables(n)[2], "term_id", "left_semi").select("s", "term_id", "target") for n in exact]).distinct()
        every = tuple(dict.fromkeys((*output, *exact)))
        return Vocabulary(strict, self._united(every, 1), self._united(output, 2), self._united(fuzzy, 0))

    def output_edges(self, output: tuple[str, ...] = OUTPUT_SLICES) -> DataFrame:
        return self._united(output, 1)


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``kv (sample_id, kv_key, kv_value)`` and ``labels (sample_id, label)`` of a training set, without samples still to do; of equal accessions the last counts."""
    shape = "annotated_samples array<struct<attributes:map<string,string>,sample_type:string,sample_accession:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("r")).select(F.posexplode("r.annotated_samples").alias("at", "x"))
    rows = raw.select("at", F.col("x.sample_accession").alias("sample_id"), F.col("x.sample_type").alias("label"), F.map_entries("x.attributes").alias("kv")).where("label <> 'TODO'")
    last = rows.groupBy("sample_id").agg(F.max_by(F.struct("label", "kv"), "at").alias("b"))
    return last.select("sample_id", F.inline("b.kv").alias("kv_key", "kv_value")), last.select("sample_id", "b.label")


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """``(study, sample_id)`` of JSON like study -> list of samples."""
    return read_links(spark, path, "sample_id").withColumnRenamed("term_id", "study")


def mappings_as_json(mapped: DataFrame, values: DataFrame) -> DataFrame:
    """``(sample_id, json)``: a sample's mapped terms and real values with their origins, in order of term and property."""
    terms = mapped.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "consequent", F.col("orig_key").alias("original_key"), F.col("orig_value").alias("original_value"), F.col("path").alias("path_to_mapping")))).alias("mapped_terms"))
    reals = values.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("property_id", "value", "unit_id", "consequent", F.col("orig_key").alias("original_key"), F.col("orig_value").alias("original_value")))).alias("real_value_properties"))
    both = terms.join(reals, "sample_id", "full")
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select("sample_id", F.to_json(F.struct(none("mapped_terms"), none("real_value_properties"))).alias("json"))


def read_mapping_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`read_mappings`, of lines ``{"sample_id": .., "json": ..}`` as :func:`mappings_as_json` gives them: files of any size, read in parallel."""
    rows = spark.read.schema("sample_id string, json string").json(path).where("sample_id is not null")
    return _mapping_tables(rows.select("sample_id", F.from_json("json", _MAPPING).alias("x")))


_REAL = "struct<property_id:string,value:double,unit_id:string,consequent:boolean>"
_MAPPING = f"struct<mapped_terms:array<struct<term_id:string,consequent:boolean>>,real_value_properties:array<{_REAL}>>"


def _mapping_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return raw.select("sample_id", F.inline("x.mapped_terms")), raw.select("sample_id", F.inline("x.real_value_properties")), raw.select("sample_id")


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``mapped (sample_id, term_id, consequent)``, ``values`` and ``samples (sample_id)`` of JSON like sample -> mappings; a sample with nothing mapped is still one."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{_MAPPING}>").alias("m"))
    return _mapping_tables(raw.select(F.explode("m").alias("sample_id", "x")))
