"""``python -m termloom annotate SAMPLES.json ... [-o OUT] [-f]`` and ``python -m termloom train ANNOTATED.json ... --model DIR``"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.operators.learning import CLASS_NAMES, OneVsRest
from termloom.plans import classify
from termloom.plans.annotate import Rules, Vocabulary, annotate, with_ancestors
from termloom.sources import readers, rule_files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("command", choices=["annotate", "train"])
    p.add_argument("samples", help="annotate: a JSON list of samples; train: an annotated set")
    p.add_argument("--obo", action="append", default=[], help="NAME=FILE")
    p.add_argument("--slices", help="configuration of the slices of the --obo files; without it all terms are used")
    p.add_argument("--rules", help="folder of rule files")
    p.add_argument("--removed", help="file of synonyms to leave out (with --slices)")
    p.add_argument("--lexicon", help="folder of the lexicon")
    p.add_argument("--model", help="folder of the sample types' model")
    p.add_argument("--studies", help="train: JSON of studies and their samples; the first of each counts")
    p.add_argument("--stop-words", help="train: a word a line")
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--fine_grained", action="store_true")
    a = p.parse_args(argv)
    if not a.obo:
        p.error("an --obo is needed")
    if a.command == "train" and not a.model:
        p.error("train needs --model")
    return a


def vocabulary(spark: SparkSession, a: argparse.Namespace) -> tuple[Vocabulary, DataFrame, DataFrame]:
    """The vocabulary, the edges for ancestors and the subsets ``(term_id, subset)`` of its terms."""
    files = dict(x.split("=", 1) for x in a.obo)
    obos = [readers.read_obo(spark, path, name) for name, path in files.items()]
    kinds = staged(reduce(DataFrame.unionByName, [o["subset"] for o in obos]).select("term_id", "subset").distinct(), "subsets")
    if a.slices:
        s = rule_files.Slices(spark, a.slices, files, removed=rule_files.removed_synonyms(spark, a.removed) if a.removed else None)
        have = lambda names: tuple(n for n in names if set(s.config[n]["included_ontology_projects"]) & set(files))
        out = have(rule_files.OUTPUT_SLICES)
        return s.vocabulary(have(rule_files.EXACT_SLICES), have(rule_files.FUZZY_SLICES), out), s.output_edges(out), kinds
    names = reduce(DataFrame.unionByName, [readers.dictionary(o) for o in obos]).distinct()
    edges = reduce(DataFrame.unionByName, [o["rel"] for o in obos]).where("rel in ('is_a', 'part_of')").select("child", "parent").distinct()
    return Vocabulary(staged(names, "names"), staged(edges, "edges")), edges, kinds


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    vocab, edges, kinds = vocabulary(spark, a)
    rules = rule_files.read_rules(spark, a.rules) if a.rules else Rules()
    if a.lexicon:
        rules.lexicon = readers.read_lexicon_folder(spark, a.lexicon)
    if a.command == "train":
        kv, labels = rule_files.read_annotated(spark, a.samples)
        kept = classify.training_samples(labels, rule_files.read_studies(spark, a.studies) if a.studies else None)
    else:
        kv = readers.read_sample_list(spark, a.samples)
    mapped, values = annotate(spark, kv, vocab, rules)
    mapped, values = staged(mapped, "mapped"), staged(values, "values")
    above = staged(with_ancestors(mapped, edges), "above")
    terms = above.select("sample_id", F.explode("terms").alias("term_id"))
    if a.command == "train":
        stop = spark.read.text(a.stop_words).select(F.trim("value").alias("gram")).distinct() if a.stop_words else None
        classify.train(kv, terms, kept, stop).save(a.model)
        return
    n = readers.count_sample_list(spark, a.samples)
    out: list[dict] = [{"mapped ontology terms": [], "real-value properties": []} for _ in range(n)]  # the command line's own small output
    for r in above.collect():
        out[r["sample_id"]]["mapped ontology terms"] = r["terms"]
    for r in values.select("sample_id", "property_id", "value", "unit_id").distinct().orderBy("property_id", "value", "unit_id").collect():
        out[r["sample_id"]]["real-value properties"].append({"property_id": r["property_id"], "value": r["value"], "unit_id": r["unit_id"]})
    if a.model:
        every = spark.range(n).select(F.col("id").cast("int").alias("sample_id"))
        for r in classify.predict(OneVsRest.load(spark, a.model), kv, terms, values, kinds, every).collect():
            out[r["sample_id"]] |= {"sample type": CLASS_NAMES.get(r["sample_type"], r["sample_type"]), "sample-type confidence": r["confidence"]}
    if a.fine_grained:
        for o in out:
            o |= {"explicitly_mapped_terms": [], "consequent_terms": []}
        for r in mapped.orderBy("term_id").collect():
            out[r["sample_id"]]["consequent_terms" if r["consequent"] else "explicitly_mapped_terms"].append(r["term_id"])
    text = readers.pretty_json(out)
    if a.output:
        with open(a.output, "w") as f:
            f.write(text)
    else:
        print(text)


if __name__ == "__main__":
    main()
