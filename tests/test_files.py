import json

import pytest

from termloom.__main__ import main
from termloom.operators.learning import CLASS_NAMES
from termloom.sources import readers, rule_files

CL = """format-version: 1.2

[Term]
id: CL:0
name: cell

[Term]
id: CL:1
name: blood cell
is_a: CL:0 ! cell

[Term]
id: CL:2
name: white cell
synonym: "leukocyte" EXACT []
synonym: "bad word" EXACT []
is_a: CL:1 ! blood cell

[Term]
id: CL:9
name: apart
"""
CVCL = """format-version: 1.2

[Term]
id: CVCL:1
name: jurkat
subset: Cancer_cell_line
"""
CONFIG = {
    "1": {"included_ontology_projects": ["CL"], "restrict_to_specific_subgraph": True, "subgraph_roots": {"CL:1": "blood cell"}, "id_spaces": ["CL"], "exclude_terms": {"CL:1": "blood cell"}},
    "4": {"included_ontology_projects": ["CVCL"], "restrict_to_specific_subgraph": False, "id_spaces": ["CVCL"], "exclude_terms": []},
    **{n: {"included_ontology_projects": ["NONE"], "restrict_to_specific_subgraph": False, "id_spaces": [], "exclude_terms": []} for n in ("2", "5", "7", "8", "9", "12", "16", "18")},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "rules").mkdir()
    (d / "cl.obo").write_text(CL)
    (d / "cvcl.obo").write_text(CVCL)
    (d / "slices.json").write_text(json.dumps(CONFIG))
    (d / "removed.json").write_text(json.dumps({"CL:2": {"name": "white cell", "exclude_synonyms": ["bad word", "white cell"]}}))
    put = lambda kind, text: (d / "rules" / rule_files.FILES[kind]).write_text(text if isinstance(text, str) else json.dumps(text))
    put("filter", {"filter_keys": ["project"], "filter_values": ["n/a", "n/a"]})
    put("synonyms", [["a", "b"], ["c"]])
    put("property_synonyms", '{"P:1": [["x", "y"], ["z"]], "P:2": ["gone"], "P:2": ["th1", "T-helper"]}')
    put("combinations", [{"required_terms": {"CL:2": "white cell"}, "required_artifacts": [["naive", "fresh"]], "consequent_term": "CL:3"}])
    put("properties", {"property_term_ids": {"EFO:1": "age"}, "default_units": {}})
    put("superterms", {"CL:2": ["L:1", "L:1", "L:2"]})
    put("facts", {"CVCL:1": {"mapped_terms": ["D:1"], "real_value_properties": [["EFO:1", 14, "UO:1"]]}, "CVCL:2": {"mapped_terms": [], "real_value_properties": []}})
    return d


def test_rule_files(spark, folder):
    r = rule_files.read_rules(spark, str(folder / "rules"))
    assert (r.filter_keys, r.filter_values, r.properties, r.default_units, r.acronyms) == (["project"], ["n/a"], ["EFO:1"], {}, {})
    assert {tuple(x) for x in r.property_sets.collect()} == {("P:1", 0, "x"), ("P:1", 0, "y"), ("P:1", 1, "z"), ("P:2", 0, "th1"), ("P:2", 0, "T-helper")}
    assert {tuple(x) for x in r.superterm_links.collect()} == {("CL:2", "L:1"), ("CL:2", "L:2")} and r.disease_links is None
    assert [[tuple(x) for x in f.collect()] for f in r.facts] == [[("CVCL:1", "D:1")], [("CVCL:1", "EFO:1", 14.0, "UO:1")]]
    assert [tuple(x) for x in r.combinations[2].collect()] == [(0, "CL:3")] and r.combinations[1].count() == 2


def test_slices(spark, folder):
    s = rule_files.Slices(spark, str(folder / "slices.json"), {"CL": str(folder / "cl.obo"), "CVCL": str(folder / "cvcl.obo")}, removed=rule_files.removed_synonyms(spark, str(folder / "removed.json")))
    v = s.vocabulary(("1",), ("1", "4"), ("1",))
    assert {tuple(x) for x in v.dictionary.collect()} == {("white cell", "CL:2", "TERM_NAME"), ("leukocyte", "CL:2", "EXACT")}
    assert {x.term_id for x in v.fuzzy.collect()} == {"CL:1", "CL:2", "CVCL:1"}
    assert [tuple(x) for x in v.edges.collect()] == [("CL:2", "CL:1")] and [x.term_id for x in v.mappable.collect()] == ["CL:2"]


def test_readers_of_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"a": "1", "b": "2", "a": "3"}, {}, {"n": 5}]')
    assert {tuple(x) for x in readers.read_sample_list(spark, str(tmp_path / "s.json")).collect()} == {(0, "a", "3"), (0, "b", "2"), (2, "n", "5")}
    assert readers.count_sample_list(spark, str(tmp_path / "s.json")) == 3
    (tmp_path / "t.json").write_text(json.dumps({"annotated_samples": [{"attributes": {"a": "1"}, "sample_type": t, "sample_accession": i} for i, t in (("x", "tissue"), ("y", "TODO"), ("x", "other"))]}))
    kv, labels = rule_files.read_annotated(spark, str(tmp_path / "t.json"))
    assert [tuple(x) for x in labels.collect()] == [("x", "other")] and [tuple(x) for x in kv.collect()] == [("x", "a", "1")]


def test_command_line(spark, folder, tmp_path, capsys):
    kinds = ("cell_line", "tissue")
    rows = [{"attributes": {"note": ("cultured jurkat" if i % 2 == 0 else "biopsy leukocyte") + f" number{i}"}, "sample_type": kinds[i % 2], "sample_accession": f"s{i:02d}"} for i in range(16)]
    (tmp_path / "set.json").write_text(json.dumps({"annotated_samples": rows}))
    (tmp_path / "in.json").write_text(json.dumps([{"cells": "Leukocyte", "note": "biopsy", "project": "jurkat"}, {}, {"source": "cultured thing"}]))
    obo = ["--obo", f"CL={folder}/cl.obo", "--obo", f"CVCL={folder}/cvcl.obo", "--slices", f"{folder}/slices.json", "--removed", f"{folder}/removed.json", "--rules", f"{folder}/rules"]
    main(["train", str(tmp_path / "set.json"), *obo, "--model", str(tmp_path / "model")])
    main(["annotate", str(tmp_path / "in.json"), *obo, "--model", str(tmp_path / "model"), "-f"])
    out = json.loads(capsys.readouterr().out)
    assert [o["mapped ontology terms"] for o in out] == [["CL:1", "CL:2"], [], []]
    assert [o["explicitly_mapped_terms"] for o in out] == [["CL:2"], [], []] and all(o["consequent_terms"] == [] for o in out)
    assert [out[i]["sample type"] for i in (0, 2)] == ["tissue", "cell line"] and all(o["sample type"] in CLASS_NAMES.values() and 0 < o["sample-type confidence"] <= 1 for o in out)


def test_mappings_round_trip(spark, tmp_path):
    path = "array<struct<step:string,node:string>>"
    mapped = spark.createDataFrame([("a", "T:2", False, "k", "v", []), ("a", "T:1", True, "k", "v", [("val", "v")])], f"sample_id string, term_id string, consequent boolean, orig_key string, orig_value string, path {path}")
    values = spark.createDataFrame([("b", "P:1", 2.0, None, False, "k", "v")], "sample_id string, property_id string, value double, unit_id string, consequent boolean, orig_key string, orig_value string")
    whole = {r.sample_id: json.loads(r.json) for r in rule_files.mappings_as_json(mapped, values).collect()}
    assert [x["term_id"] for x in whole["a"]["mapped_terms"]] == ["T:1", "T:2"] and whole["b"]["mapped_terms"] == []
    (tmp_path / "m.json").write_text(json.dumps(whole | {"c": {"mapped_terms": [], "real_value_properties": []}}))
    m, v, s = rule_files.read_mappings(spark, str(tmp_path / "m.json"))
    assert {tuple(x) for x in m.collect()} == {("a", "T:1", True), ("a", "T:2", False)}
    assert [tuple(x) for x in v.collect()] == [("b", "P:1", 2.0, None, False)] and {x.sample_id for x in s.collect()} == {"a", "b", "c"}


def test_search_page_streams(spark):
    rows = spark.createDataFrame([(1, 'a "b"', 0.5), (2, None, 1.0)], "id int, name string, confidence double")
    page = json.loads("".join(readers.search_page(rows, ["id", "name", "confidence"])))
    assert page["error_message"] is None and {r["id"] for r in page["search_results"]} == {1, 2} and page["search_results"][0]["name"] == 'a "b"'
    assert json.loads("".join(readers.search_page(rows.limit(0), ["id"], "no such term"))) == {"error_message": "no such term", "search_results": []}
    assert readers.pretty_json({"b": [1], "a": None}) == '{\n    "a": null,\n    "b": [\n        1\n    ]\n}'


def test_obo_with_carriage_returns(spark, tmp_path):
    (tmp_path / "w.obo").write_bytes(CL.replace("\n\n", "\n  \t\n").replace("\n", "\r\n").encode())
    obo = readers.read_obo(spark, str(tmp_path / "w.obo"), "CL", ["CL"])
    assert {(r.term_id, r.name) for r in obo["term"].collect()} == {("CL:0", "cell"), ("CL:1", "blood cell"), ("CL:2", "white cell"), ("CL:9", "apart")}
    assert {(r.child, r.parent) for r in obo["rel"].collect()} == {("CL:1", "CL:0"), ("CL:2", "CL:1")}


def test_tables_that_cannot_be_read(spark, tmp_path):
    readers.upsert_table(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t"), ["k"])
    readers.upsert_table(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), str(tmp_path / "t"), ["k"])
    assert {tuple(r) for r in readers.read_table(spark, str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no table")
    with pytest.raises(Exception):
        readers.upsert_table(spark, spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "broken"), ["k"])
