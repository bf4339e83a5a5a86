"""Queries of readers, writers, stored tables and rule files: files are made from the tables, read back and compared with SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.shared import shared_dir, staged
from termloom.operators import graph as G, learning as L, relational as R, tokens as K
from termloom.plans import classify
from termloom.plans.annotate import Rules, Vocabulary, annotate, link_tables
from termloom.plans.queries import _DICT, _GRAMS, _TOK, _dictionary, _grams, _halves, _part_tokens, _steps, _STEPS_SQL, query, t
from termloom.sources import readers, rule_files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str) -> str:
    """A folder of text files with the lines of ``df``'s only column."""
    path = _folder(df.sparkSession, name)
    df.write.text(path)
    return path


def _one_file(spark: SparkSession, text: str, name: str) -> str:
    return _lines(spark.createDataFrame([(text,)], "value string").coalesce(1), name)


# ---- samples ----
def _as_list(df: DataFrame, order: str, name: str) -> str:
    """A file with the list of a table's JSON objects in order of a number: a file of that kind is one text."""
    whole = df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "j"))), lambda x: x["j"]), ",\n"), F.lit("]")).alias("value"))
    return _lines(whole.coalesce(1), name)


_NATION_PAIRS = """SELECT i AS sample_id, unnest(['name', 'region']) AS kv_key, unnest([n_name, n_regionkey::VARCHAR]) AS kv_value
FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)"""


@query(f"SELECT sample_id::INTEGER AS sample_id, kv_key, kv_value FROM ({_NATION_PAIRS})")
def read_sample_list(spark, d):
    """A JSON list; the region is named twice, the last counts."""
    n = t(spark, d, "nation").select("n_nationkey", F.format_string('{"region": "none", "name": "%s", "region": %d}', "n_name", "n_regionkey").alias("j"))
    return readers.read_sample_list(spark, _as_list(n, "n_nationkey", "list"))


@query("SELECT 'N' || n_nationkey AS sample_id, unnest(['name', 'region']) AS kv_key, unnest([n_name, n_regionkey::VARCHAR]) AS kv_value FROM nation")
def read_sample_map(spark, d):
    n = t(spark, d, "nation").select(F.format_string('"N%d": {"name": "%s", "region": "%d"}', "n_nationkey", "n_name", "n_regionkey").alias("j"))
    whole = n.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("j"), ","), F.lit("}")).alias("value"))
    return readers.read_sample_map(spark, _lines(whole.coalesce(1), "map"))


@query("SELECT 'C' || c_custkey AS sample_id, unnest(['name', 'segment']) AS kv_key, unnest([c_name, c_mktsegment]) AS kv_value FROM customer")
def read_sample_lines(spark, d):
    c = t(spark, d, "customer").select(F.to_json(F.struct(F.concat(F.lit("C"), "c_custkey").alias("sample_id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("attributes"))))
    return readers.read_sample_lines(spark, _lines(c, "samples"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def read_work_list(spark, d):
    """The samples of a work list."""
    ids = t(spark, d, "orders").where("o_orderstatus = 'P'").agg(F.to_json(F.struct(F.collect_set(F.col("o_custkey").cast("string")).alias("sample_accessions"))).alias("value"))
    asked = readers.read_work_list(spark, _lines(ids.coalesce(1), "work"))
    c = t(spark, d, "customer")
    return c.join(asked, F.col("c_custkey").cast("string") == asked["sample_id"], "left_semi").select("c_custkey", "c_name")


@query("""SELECT 'E' || event_id AS sample_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS json FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'bad files', count(DISTINCT user_id)::VARCHAR FROM events WHERE event_type = 'error'""")
def gather_outputs(spark, d):
    """A file of mappings for each user; those of users' errors are cut off in the middle."""
    folder = _folder(spark, "jobs")
    e = t(spark, d, "events").select("user_id", (F.col("event_type") == "error").alias("bad"), F.format_string('"E%d": %s', "event_id", "props").alias("j"))
    files = e.groupBy("user_id", "bad").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("j"), ", "), F.when(F.col("bad"), "").otherwise("}")).alias("value"))
    # as many files as rows: the job's folder is its number
    files.select(F.concat_ws("-", "user_id", "bad").alias("job"), "value").write.partitionBy("job").text(folder)
    good, failed = readers.gather_outputs(spark, folder, "*.txt")
    return good.unionByName(failed.agg(F.lit("bad files").alias("sample_id"), F.count("*").cast("string").alias("json")))


@query("""SELECT event_type, count(*) FILTER (WHERE NOT bad)::BIGINT AS good, count(*) FILTER (WHERE bad)::BIGINT AS bad, coalesce(sum(k) FILTER (WHERE NOT bad), 0)::BIGINT AS k
FROM (SELECT *, event_id % 10 = 3 OR event_type = 'error' AS bad, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type""")
def quarantined_records(spark, d):
    """Records that are cut, or no object at all, go to a table of their own; the others go on."""
    text = F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).when(F.col("event_id") % 10 == 3, F.expr("substring(props, 1, 5)")).otherwise(F.col("props"))
    e = t(spark, d, "events").select(F.struct("event_type", "event_id").alias("key"), text.alias("text"))
    good, bad = R.without_bad_records(e, "key", "text", "k long")
    both = good.select("key.event_type", "record.k", F.lit(1).alias("g")).unionByName(bad.select("key.event_type", F.lit(None).cast("long").alias("k"), F.lit(0).alias("g")))
    return both.groupBy("event_type").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))


# ---- tables ----
@query("SELECT o_orderstatus, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS custkeys FROM orders GROUP BY o_orderstatus")
def scan_csv(spark, d):
    path = _folder(spark, "orders-csv")
    t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("header", True).csv(path)
    o = readers.read_table(spark, path, "csv", "o_orderkey long, o_custkey long, o_orderstatus string")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"))


@query("SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'view'), max(event_id)) AS event_id, bool_or(event_type = 'view') AS viewed FROM events GROUP BY user_id")
def upsert_stored_table(spark, d):
    """A table is made, rows are merged into it by key, and once more the same ones, which changes nothing."""
    path = _folder(spark, "stored")
    e = t(spark, d, "events")
    last = lambda x, viewed: x.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.lit(viewed).alias("viewed"))
    readers.upsert_table(spark, last(e, False), path, ["user_id"])
    for _ in range(2):
        readers.upsert_table(spark, last(e.where("event_type = 'view'"), True), path, ["user_id"])
    return readers.read_table(spark, path)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def recreate_table(spark, d):
    """Dropped and made anew, whether or not it was there; partitioned by segment."""
    path, c = _folder(spark, "recreated"), t(spark, d, "customer")
    readers.write_table(c.select("c_nationkey"), path)
    readers.write_table(c.select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return readers.read_table(spark, path).select("c_custkey", "c_mktsegment")


# ---- vocabularies ----
_OBO_SQL = """x AS (SELECT p_partkey AS k, 'P:' || p_partkey AS term_id, p_name, p_brand, p_type, p_size, p_size % 7 = 0 AS obsolete FROM part)"""


def _obo(spark, d) -> dict[str, DataFrame]:
    """A vocabulary file of all parts: parents are halves of the number, every seventh size is obsolete; a foreign stanza and a relation's."""
    rows = t(spark, d, "part").select(
        F.concat_ws(
            "\n",
            F.lit("[Term]"), F.format_string("id: P:%d", "p_partkey"), F.format_string("name: %s", "p_name"), F.format_string('def: "a \\"%s\\" part" [made:up]', "p_type"),
            F.format_string('synonym: "%s %s" EXACT []', "p_brand", "p_name"), F.format_string('synonym: "%s" RELATED [a:b]', "p_type"), F.format_string("subset: %s", "p_type"),
            F.format_string("xref: X:%d ! elsewhere", "p_size"), F.format_string('property_value: size "%d" xsd:int', "p_size"), F.lit("property_value: kind part"),
            F.when(F.col("p_partkey") > 1, F.format_string("is_a: P:%d ! half", F.expr("p_partkey div 2"))), F.lit("is_a: F:1 ! foreign"), F.lit("relationship: part_of F:2 ! whole"),
            F.when(F.col("p_size") % 7 == 0, F.lit("is_obsolete: true")), F.lit("comment: none: at all"), F.lit(""),
        ).alias("value")
    )
    extra = spark.createDataFrame([("[Term]\nid: F:1\nname: foreign\n",), ("[Typedef]\nid: part_of\nname: part of\n",), ("[Term]\nid: P:none\n",)], "value string")
    return readers.read_obo(spark, _lines(rows.unionByName(extra), "obo"), "P", ["P"])


@query(f"""WITH {_OBO_SQL} SELECT term_id, p_name AS name, 'a \\"' || p_type || '\\" part' AS definition, 'none: at all' AS comment, 'P' AS idspace FROM x WHERE NOT obsolete""")
def obo_terms(spark, d):
    return _obo(spark, d)["term"].select("term_id", "name", "definition", "comment", "idspace")


@query(f"""WITH {_OBO_SQL} SELECT term_id, p_brand || ' ' || p_name AS syn, 'EXACT' AS syn_type FROM x WHERE NOT obsolete UNION SELECT term_id, p_type, 'RELATED' FROM x WHERE NOT obsolete""")
def obo_synonyms(spark, d):
    return _obo(spark, d)["synonym"].select("term_id", "syn", "syn_type")


@query(f"""WITH {_OBO_SQL} SELECT term_id AS child, 'is_a' AS rel, 'P:' || k // 2 AS parent FROM x WHERE NOT obsolete AND k > 1 UNION SELECT term_id, 'part_of', 'F:2' FROM x WHERE NOT obsolete""")
def obo_relations(spark, d):
    return _obo(spark, d)["rel"].select("child", "rel", "parent")


@query(f"""WITH {_OBO_SQL} SELECT term_id, 'subset' AS kind, p_type AS value FROM x WHERE NOT obsolete UNION SELECT term_id, 'xref', 'X:' || p_size FROM x WHERE NOT obsolete
UNION SELECT term_id, 'size', p_size::VARCHAR FROM x WHERE NOT obsolete UNION SELECT term_id, 'kind', 'part' FROM x WHERE NOT obsolete""")
def obo_annotations(spark, d):
    o = _obo(spark, d)
    subset = o["subset"].select("term_id", F.lit("subset").alias("kind"), F.col("subset").alias("value"))
    xref = o["xref"].select("term_id", F.lit("xref").alias("kind"), F.col("xref").alias("value"))
    return subset.unionByName(xref).unionByName(o["property"].select("term_id", F.col("prop").alias("kind"), F.col("val").alias("value")))


@query(f"WITH {_OBO_SQL} SELECT DISTINCT p_name AS s, term_id, 'TERM_NAME' AS target FROM x WHERE NOT obsolete UNION SELECT p_type, term_id, 'RELATED' FROM x WHERE NOT obsolete AND p_type <> 'PROMO' UNION SELECT p_brand || ' ' || p_name, term_id, 'EXACT' FROM x WHERE NOT obsolete")
def obo_dictionary(spark, d):
    """Names and synonyms without some that are to be removed."""
    o = _obo(spark, d)
    gone = o["synonym"].where("syn = 'PROMO'").select("term_id", F.col("syn").alias("s"))
    return readers.dictionary(o, gone)


@query("SELECT o_orderkey, replace(replace(o_orderpriority || ' CL:1 CVCL_2', 'CVCL_', 'CVCL:'), 'CL:', 'EFO_CL:') AS line FROM orders")
def renamed_spaces(spark, d):
    o = t(spark, d, "orders").select(F.concat("o_orderkey", F.lit("|"), "o_orderpriority", F.lit(" CL:1 CVCL_2")).alias("value"))
    out = readers.rename_spaces(spark, _lines(o, "spaces"), [("CVCL_", "CVCL:"), ("CL:", "EFO_CL:")])
    return out.select(F.split_part("value", F.lit("|"), F.lit(1)).cast("long").alias("o_orderkey"), F.split_part("value", F.lit("|"), F.lit(2)).alias("line"))


def _slices(spark, d) -> rule_files.Slices:
    """Slices of a vocabulary of parts: all of it without one kind of term, and what is below two of its terms."""
    rows = t(spark, d, "part").where("p_partkey >= 1").select(
        F.concat_ws("\n", F.lit("[Term]"), F.format_string("id: P:%d", "p_partkey"), F.format_string("name: part %d %s", "p_partkey", "p_name"), F.format_string('synonym: "%s" EXACT []', "p_type"),
                    F.when(F.col("p_partkey") > 1, F.format_string("is_a: P:%d", F.expr("p_partkey div 2"))), F.lit("")).alias("value")
    )
    config = {
        "1": {"included_ontology_projects": ["P"], "restrict_to_specific_subgraph": False, "id_spaces": ["P"], "exclude_terms": {"P:5": "part", "P:7": "part"}},
        "2": {"included_ontology_projects": ["P"], "restrict_to_specific_subgraph": True, "subgraph_roots": {"P:3": "part", "P:8": "part"}, "id_spaces": [], "exclude_terms": []},
    }
    return rule_files.Slices(spark, _one_file(spark, json.dumps(config), "slices"), {"P": _lines(rows, "slice-obo")})


_BELOW = """b(k) AS (SELECT unnest([3, 8])::BIGINT UNION SELECT p_partkey FROM part, b WHERE p_partkey > 1 AND p_partkey // 2 = k), s AS (SELECT DISTINCT b.k FROM b JOIN part ON p_partkey = b.k)"""


@query(f"""WITH RECURSIVE {_BELOW}
SELECT 's' AS kind, 'P:' || k AS a, 'part ' || k || ' ' || p_name AS b FROM s JOIN part ON p_partkey = k
UNION ALL SELECT 's', 'P:' || k, p_type FROM s JOIN part ON p_partkey = k UNION ALL SELECT 'edge', 'P:' || k, 'P:' || k // 2 FROM s WHERE k // 2 IN (SELECT k FROM s)
UNION ALL SELECT 'mappable', 'P:' || p_partkey, NULL FROM part WHERE p_partkey >= 1 AND p_partkey NOT IN (5, 7)""")
def vocabulary_slices(spark, d):
    """Names and edges of one slice, mappable terms of another."""
    s = _slices(spark, d)
    names, edges, _ = s.tables("2")
    mappable = s.tables("1")[2]
    none = F.lit(None).cast("string")
    return (
        names.select(F.lit("s").alias("kind"), F.col("term_id").alias("a"), F.col("s").alias("b"))
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("child").alias("a"), F.col("parent").alias("b")))
        .unionByName(mappable.select(F.lit("mappable").alias("kind"), F.col("term_id").alias("a"), none.alias("b")))
    )


@query(f"""WITH RECURSIVE {_BELOW}, m AS (SELECT p_partkey AS k, p_name, p_type FROM part WHERE p_partkey >= 1 AND p_partkey NOT IN (5, 7) UNION SELECT k, p_name, p_type FROM s JOIN part ON p_partkey = k)
SELECT 'P:' || k AS term_id, 'part ' || k || ' ' || p_name AS s FROM m UNION ALL SELECT 'P:' || k, p_type FROM m""")
def united_slices(spark, d):
    """What the mappable terms of either slice are matched by."""
    return _slices(spark, d).vocabulary(("1", "2"), ("1",), ("1",)).dictionary.select("term_id", "s")


# ---- lexicons ----
def _lexicon(spark, d) -> str:
    """A lexicon's folder: a word for each distinct part name, with a spelling, two inflections, a nominalization and a trademark."""
    folder = _folder(spark, "lexicon")
    w = staged(t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct(), "lexicon-words")
    put = lambda name, rows: rows.write.text(f"{folder}/{name}")
    put("LEXICON", w.select(F.format_string("{base=%s\nentry=E_%s\n\tcat=noun\n}", "w", "w").alias("value")))
    put("LRSPL", w.select(F.format_string("E_%s|%se|%s|", "w", "w", "w").alias("value")).unionByName(spark.createDataFrame([("E_unknown|x|y|",)], "value string")))
    put("LRAGR", w.select(F.explode(F.array(F.format_string("E_%s|%ss|noun|", "w", "w"), F.format_string("E_%s|%s|noun|", "w", "w"))).alias("value")))
    put("LRNOM", w.select(F.format_string("E_%s|%sness|", "w", "w").alias("value")))
    put("LRTRM", w.select(F.format_string("E_%s|%s|%sTM|", "w", "w", "w").alias("value")))
    return folder


_LEXICON_SQL = """w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
v AS (SELECT 'E_' || w AS eui, unnest(['base', 'spelling', 'inflection', 'nominalization', 'trademark']) AS kind, unnest([w, w || 'e', w || 's', w || 'ness', w || 'TM']) AS variant FROM w)"""


@query(f"WITH {_LEXICON_SQL} SELECT eui, kind, variant FROM v")
def lexicon_tables(spark, d):
    return readers.read_lexicon_folder(spark, _lexicon(spark, d))[1].select("eui", "kind", "variant")


@query(f"""WITH {_TOK}, {_LEXICON_SQL}, f AS (SELECT DISTINCT eui, variant AS form FROM v), l AS (SELECT *, list_extract(string_split(tok, ' '), -1) AS last FROM tok)
SELECT DISTINCT sample_id, left(tok, length(tok) - length(last)) || v.variant AS tok, s::INTEGER AS start, e::INTEGER AS "end" FROM l JOIN f ON last = form JOIN v USING (eui) WHERE v.kind IN ('base', 'spelling') AND v.variant <> last""")
def spelling_variants(spark, d):
    forms, variants = readers.read_lexicon_folder(spark, _lexicon(spark, d))
    return K.lexicon_variants(_part_tokens(spark, d), forms, variants, ["spelling"]).select("sample_id", "tok", "start", "end")


# ---- mappings and training sets ----
@query("""WITH RECURSIVE c(term_id, ancestor) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT term_id, ancestor // 2 FROM c WHERE ancestor > 1)
SELECT 'S' || o_custkey AS sample_id, string_agg(DISTINCT 'T' || ancestor, ',' ORDER BY 'T' || ancestor) AS terms, any_value(n) AS n_values
FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) JOIN c ON term_id = 1 + o_orderkey % (SELECT count(*) - 1 FROM part) GROUP BY o_custkey""")
def mappings_with_ancestors(spark, d):
    """Mappings are written as JSON lines, read back, and get the ancestors of their terms."""
    parts = t(spark, d, "part").count() - 1
    mapped = t(spark, d, "orders").select(F.concat(F.lit("S"), "o_custkey").alias("sample_id"), F.concat(F.lit("T"), 1 + F.col("o_orderkey") % parts).alias("term_id"), "o_orderkey")
    nothing = F.array().cast("array<struct<step:string,node:string>>")
    of = lambda c: {"consequent": F.lit(False), "orig_key": F.lit("k"), "orig_value": F.col("o_orderkey").cast("string")} | c
    terms = mapped.withColumns(of({"path": nothing})).dropDuplicates(["sample_id", "term_id"])
    values = mapped.withColumns(of({"property_id": F.lit("P:1"), "value": F.col("o_orderkey").cast("double"), "unit_id": F.lit("U:1")}))
    path = _folder(spark, "mappings")
    rule_files.mappings_as_json(terms.drop("o_orderkey"), values.drop("o_orderkey", "term_id")).write.json(path)
    back, real, samples = rule_files.read_mapping_lines(spark, path)
    edges = _halves(spark, d).select(F.concat(F.lit("T"), "child").alias("child"), F.concat(F.lit("T"), "parent").alias("parent"))
    above = G.closure_of_all(edges, back.select("term_id").distinct())
    sets = back.join(above, "term_id").groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ",").alias("terms"))
    return samples.join(sets, "sample_id").join(real.groupBy("sample_id").agg(F.count("*").alias("n_values")), "sample_id").select("sample_id", "terms", "n_values")


@query("SELECT 'C' || c_custkey AS sample_id, c_mktsegment AS label, c_name AS kv_value FROM customer WHERE c_mktsegment <> 'BUILDING'")
def read_annotated_set(spark, d):
    """A training set; one class is still to do, the first half of the samples is there twice, the last counts."""
    c = t(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "TODO").otherwise(F.col("c_mktsegment"))
    obj = lambda k: F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("attributes"), k.alias("sample_type"), F.concat(F.lit("C"), "c_custkey").alias("sample_accession")))
    first = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("n"), obj(F.lit("other")).alias("j"))
    rows = first.unionByName(c.select((F.col("c_custkey") + 10**9).alias("n"), obj(kind).alias("j")))
    whole = rows.agg(F.concat(F.lit('{"annotated_samples": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]), ", "), F.lit("]}")).alias("value"))
    kv, labels = rule_files.read_annotated(spark, _lines(whole.coalesce(1), "annotated"))
    return labels.join(kv, "sample_id").select("sample_id", "label", "kv_value")


@query("SELECT o_custkey::VARCHAR AS sample_id, o_orderpriority AS label FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) JOIN orders USING (o_custkey, o_orderkey) WHERE o_orderpriority <> '5-LOW' AND o_custkey IN (SELECT min(c_custkey) FROM (SELECT c_custkey, c_nationkey FROM customer) GROUP BY c_nationkey)")
def training_samples(spark, d):
    """Labels without one that counts as other, of the first sample of each study."""
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    labels = o.select("o_custkey", F.when(F.col("p") == "5-LOW", "other").otherwise(F.col("p")).alias("label")).withColumnRenamed("o_custkey", "sample_id")
    studies = t(spark, d, "customer").select(F.col("c_nationkey").alias("study"), F.col("c_custkey").alias("sample_id"))
    return classify.training_samples(labels, studies).select(F.col("sample_id").cast("string").alias("sample_id"), "label")


@query("SELECT count(*)::BIGINT AS n_samples, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS n_unmapped FROM documents")
def job_counters(spark, d):
    """Samples and those of them without a mapping, which are counted and left out of the prediction."""
    kv = t(spark, d, "documents").selectExpr("doc_id as sample_id", "'text' as kv_key", "text as kv_value")
    return classify.unmapped(kv, t(spark, d, "labels").select(F.col("doc_id").alias("sample_id")))


@query(f"""WITH {_GRAMS}, f AS (SELECT gram FROM g WHERE length(gram) > 1 GROUP BY gram HAVING count(DISTINCT sample_id) > 20)
SELECT sample_id, gram, count(*)::BIGINT AS n FROM g JOIN f USING (gram) GROUP BY ALL UNION ALL SELECT doc_id, chr(1) || 'T:' || quality, 1 FROM labels""")
def feature_vectors(spark, d):
    """Counts of frequent words and presence of terms, as the classifier's vectors hold them."""
    grams = _grams(t(spark, d, "documents"))
    terms = t(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("T:"), "quality").alias("term_id"))
    both = L.features(grams, terms)
    chosen = L.vocabulary(grams, 20).select("gram").unionByName(both.where(F.startswith("gram", F.lit(L.TERM_MARK))).select("gram").distinct())
    return L.feature_counts(both, chosen)


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_equal FROM labels")
def saved_model(spark, d):
    """A model that was saved and loaded gives the scores that it gave."""
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 0, "junk").otherwise("good").alias("label"))
    grams = _grams(t(spark, d, "documents").join(labels.select(F.col("sample_id").alias("doc_id")), "doc_id", "left_semi"))
    model, path = L.OneVsRest(rounds=5).fit(grams, labels), _folder(spark, "model")
    model.save(path)
    before, after = (L.normalized_best(m.scores(grams)) for m in (model, L.OneVsRest.load(spark, path)))
    met = labels.select("sample_id").join(before, "sample_id", "left").join(after.select("sample_id", F.col("label").alias("l"), F.col("confidence").alias("c")), "sample_id", "left")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("label").eqNullSafe(F.col("l")) & F.col("confidence").eqNullSafe(F.col("c"))).alias("n_equal"))


# ---- links and graphs ----
@query(f"""WITH {_DICT}, a AS (SELECT DISTINCT s, term_id FROM dict WHERE term_id LIKE 'PT:%'), b AS (SELECT DISTINCT s, term_id FROM dict WHERE term_id LIKE 'PN:%'),
i AS (SELECT DISTINCT b.term_id AS b_id, a.term_id AS a_id FROM a, b WHERE length(a.s) > 2 AND length(b.s) > 2 AND a.s <> b.s AND contains(b.s, a.s)
  AND len(list_filter(string_split(a.s, ' '), lambda w: NOT list_contains(string_split(b.s, ' '), w))) = 0 AND b.term_id NOT IN (SELECT b2.term_id FROM b b2 JOIN a a2 ON a2.s = b2.s))
SELECT b_id AS term_id, a_id AS linked_id FROM i WHERE a_id <> 'PT:' || split_part(split_part(b_id, ':', 2), '_', 1)""")
def implications_without_links(spark, d):
    """What a name implies, without what its term is linked to already: the first word of the name."""
    x = _dictionary(spark, d)
    found = R.implications(x.where("term_id like 'PT:%'"), x.where("term_id like 'PN:%'")).select(F.col("b_id").alias("term_id"), F.col("a_id").alias("linked_id"))
    known = x.where("term_id like 'PN:%'").select("term_id", F.concat(F.lit("PT:"), F.split("s", " ")[0]).alias("linked_id"))
    return R.subtract_links(found, known)


@query("""WITH RECURSIVE c(x, y) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT x, y // 2 FROM c WHERE y > 1),
b AS (SELECT DISTINCT p_partkey AS k, p_name AS s FROM part WHERE p_partkey >= 1 AND p_size > 25), a AS (SELECT DISTINCT p_name AS s, p_partkey AS k FROM part WHERE p_partkey >= 1 AND p_size <= 5),
l AS (SELECT DISTINCT 'B:' || b.k AS b_id, 'A:' || a.k AS a_id, b.k FROM b JOIN a USING (s))
SELECT DISTINCT 'B:' || x AS term_id, a_id AS linked_id FROM c JOIN l ON l.k = c.y WHERE x IN (SELECT k FROM b)""")
def linked_tables(spark, d):
    """Terms of one space linked to terms of another by equal names, handed down the hierarchy."""
    p = t(spark, d, "part").where("p_partkey >= 1")
    names = lambda space, where: p.where(where).select(F.concat(F.lit(space), "p_partkey").alias("term_id"), F.col("p_name").alias("s"), F.lit("TERM_NAME").alias("target"))
    edges = _halves(spark, d).select(F.concat(F.lit("B:"), "child").alias("child"), F.concat(F.lit("B:"), "parent").alias("parent"))
    return link_tables(names("A:", "p_size <= 5").unionByName(names("B:", "p_size > 25")), edges, "A", "B")


@query(f"WITH {_STEPS_SQL} SELECT DISTINCT src AS node, dst AS child FROM e WHERE src IN (SELECT n_nationkey FROM nation)")
def node_children(spark, d):
    return G.children(_steps(spark, d), t(spark, d, "nation").selectExpr("bigint(n_nationkey) as node"))


@query(f"WITH {_STEPS_SQL} SELECT src AS node, 'node' AS kind FROM e UNION SELECT dst, 'node' FROM e UNION SELECT c_custkey + 1000000, 'node' FROM customer UNION SELECT s_suppkey, 'target' FROM supplier WHERE s_suppkey IN (SELECT dst FROM e)")
def graph_nodes(spark, d):
    """All nodes of a graph with nodes of no edge, and the mapping targets that edges lead to."""
    alone = t(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("node"))
    e = _steps(spark, d)
    return G.all_nodes(alone, e).withColumn("kind", F.lit("node")).unionByName(G.targets(e, t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))).withColumn("kind", F.lit("target")))


@query(f"WITH {_STEPS_SQL} SELECT DISTINCT src, dst FROM e WHERE label <> 'shortcut' AND (src, dst) NOT IN (SELECT src, dst FROM e WHERE label = 'shortcut')")
def edges_deleted(spark, d):
    e = _steps(spark, d)
    return G.delete_edges(e.select("src", "dst").distinct(), e.where("label = 'shortcut'"))


@query("SELECT 'P:' || p_partkey // 2 AS term_id, 'P:' || p_partkey AS sub_id, p_name AS name FROM part WHERE p_size % 7 <> 0 AND p_partkey > 1 AND p_partkey // 2 IN (SELECT n_nationkey FROM nation)")
def direct_subterms(spark, d):
    o = _obo(spark, d)
    return G.direct_subterms(o["rel"], o["term"], t(spark, d, "nation").select(F.concat(F.lit("P:"), "n_nationkey").alias("term_id")))


@query("SELECT 'https' AS x, count(*)::BIGINT AS n FROM pages WHERE url LIKE 'https%' UNION ALL SELECT 'http', count(*) FROM pages WHERE url NOT LIKE 'https%'")
def rule_filters(spark, d):
    """Pairs that two block lists from rule files leave: one of its own for collections of cell lines."""
    folder = _folder(spark, "rules")
    kv = t(spark, d, "pages").select(F.col("page_id").alias("sample_id"), F.when(F.col("url").startswith("https"), "https").otherwise("http").alias("kv_key"), F.lit("v").alias("kv_value"))
    more = kv.withColumn("kv_key", F.lit("project")).unionByName(kv.withColumn("kv_key", F.lit("depositor"))).unionByName(kv.withColumn("kv_value", F.lit("n/a")))
    files = {"filter": {"filter_keys": ["project"], "filter_values": ["n/a"]}, "cell_line_filter": {"filter_keys": ["depositor"], "filter_values": []}}
    rules = rule_files.read_rules(spark, {k: _one_file(spark, json.dumps(x), f"{folder.rsplit('/', 1)[-1]}-{k}") for k, x in files.items()})
    left = K.block_pairs(K.block_pairs(kv.unionByName(more), rules.filter_keys, rules.filter_values), rules.cell_line_keys, rules.cell_line_values)
    return left.groupBy(F.col("kv_key").alias("x")).agg(F.count("*").alias("n"))


# ---- every rule of the annotation ----
_RULES_SQL = """x AS (SELECT p_partkey AS id, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name AS v, CASE WHEN p_size % 2 = 0 THEN 'source' ELSE 'note' END AS k FROM part),
y AS (SELECT *, k = 'source' AS line_key, a = 'cold' AND b = 'anvil' AS phrase, b = 'widget' AND k = 'source' AS line FROM x),
r AS (
  SELECT id, 'A:' || a AS term_id, false AS c, k, v, 3 AS hops FROM y WHERE NOT phrase
  UNION ALL SELECT id, 'B:' || b, false, k, v, 3 FROM y WHERE NOT phrase AND b <> 'widget'
  UNION ALL SELECT id, 'CVCL:7', false, k, v, 3 FROM y WHERE line
  UNION ALL SELECT id, 'EFO:0000322', false, k, v, 2 FROM y WHERE line_key
  UNION ALL SELECT id, 'L:ring', true, k, v, 4 FROM y WHERE b = 'ring'
  UNION ALL SELECT id, 'D:7', false, k, v, 4 FROM y WHERE line
  UNION ALL SELECT id, 'C:red', true, k, v, 4 FROM y WHERE a = 'red'
  UNION ALL SELECT id, 'R:1', false, k, v, 4 FROM y WHERE a = 'small' AND b IN ('ring', 'rod')
  UNION ALL SELECT id, 'F:7', true, k, v, 4 FROM y WHERE line
  UNION ALL SELECT id, unnest(['EFO:0001272', 'UBERON:0007023']), true, k, v, 2 FROM y WHERE line
  UNION ALL SELECT id, unnest(['CL:0000010', 'EFO_BTO:0000214']), true, k, v, 4 FROM y WHERE line
  UNION ALL SELECT id, 'S:warm', false, k, v, 4 FROM y WHERE a = 'hot'
  UNION ALL SELECT id, 'N:H9', false, 'code', 'H9', 2 FROM y WHERE p_size > 40
)"""


@query(f"WITH {_RULES_SQL} SELECT id AS sample_id, term_id, c AS consequent, k AS orig_key, v AS orig_value, hops::INTEGER AS hops FROM r WHERE term_id <> 'B:bolt'")
def annotate_rules(spark, d):
    """Names of parts under a key that licenses cell lines or another, through every kind of rule.

    Synonyms, texts of two characters, phrases that own their words, blocked cell lines, linked terms, diseases,
    consequences, a combination, facts with an age, cultured cells, and terms that aren't mappable.
    """
    p = t(spark, d, "part")
    make = spark.createDataFrame
    words = p.select(F.split("p_name", " ").alias("w"))
    first, second = words.select(F.col("w")[0].alias("s")).distinct(), words.select(F.col("w")[1].alias("s")).distinct()
    named = lambda x, c: x.select("s", c.alias("term_id"), F.lit("TERM_NAME").alias("target"))
    names = named(first, F.concat(F.lit("A:"), "s")).unionByName(named(second, F.when(F.col("s") == "widget", "CVCL:7").otherwise(F.concat(F.lit("B:"), "s"))))
    names = names.unionByName(make([("source", "EFO:0000322", "TERM_NAME"), ("warm", "S:warm", "TERM_NAME")], names.schema))
    rules = Rules(
        synonym_sets=make([(0, "hot"), (0, "warm")], "set_id int, member string"), two_characters={"H9": ["N:H9"]}, noun_phrases=["cold anvil"],
        superterm_links=make([("B:ring", "L:ring")], "term_id string, linked_id string"), disease_links=make([("CVCL:7", "D:7")], "term_id string, implied_id string"),
        consequents={"A:red": ["C:red"]},
        combinations=(make([("R:1", "A:small")], "rule string, term_id string"), make([("R:1", 0, "ring"), ("R:1", 0, "rod")], "rule string, set_no int, tok string"), make([("R:1", "R:1")], "rule string, term_id string")),
        facts=(make([("CVCL:7", "F:7")], "fact_id string, term_id string"), make([("CVCL:7", "EFO:0000246", 60.0, "UO:0000036")], "fact_id string, property_id string, value double, unit_id string")),
    )
    name = p.select(F.col("p_partkey").alias("sample_id"), F.when(F.col("p_size") % 2 == 0, "source").otherwise("note").alias("kv_key"), F.col("p_name").alias("kv_value"))
    code = p.where("p_size > 40").select(F.col("p_partkey").alias("sample_id"), F.lit("code").alias("kv_key"), F.lit("H9").alias("kv_value"))
    implied = make([(x,) for x in ("L:ring", "D:7", "C:red", "R:1", "F:7", "EFO:0001272", "UBERON:0007023", "CL:0000010", "EFO_BTO:0000214", "N:H9")], "term_id string")
    mappable = names.where("term_id <> 'B:bolt'").select("term_id").unionByName(implied).distinct()
    vocab = Vocabulary(names, make([], "child string, parent string"), mappable)
    mapped, _ = annotate(spark, name.unionByName(code), vocab, rules)
    return mapped.select("sample_id", "term_id", "consequent", "orig_key", "orig_value", "hops")
