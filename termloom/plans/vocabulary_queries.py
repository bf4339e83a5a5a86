"""Queries of the operators on words, vocabularies and term graphs, each with the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import graph as G, learning as L, relational as R, tokens as K
from termloom.plans.annotate import Rules, Vocabulary, annotate, with_ancestors
from termloom.plans.queries import _DICT, _SETS, _SETS_SQL, _TOK, _dictionary, _halves, _part_tokens, query, t
from termloom.sources.readers import rows_as_json

_BLANK = r"[ \t\n\x0B\f\r]"


def _values(rows, alias: str) -> str:
    return "(VALUES " + ", ".join(str(r) for r in rows) + f") {alias}"


# ---- words ----
_FORMS = [("widget", "E1"), ("widgets", "E1"), ("anvil", "E2"), ("rod", "E3"), ("rods", "E3")]
_VARIANTS = [("E1", "base", "widget"), ("E1", "inflection", "widgets"), ("E2", "base", "anvil"), ("E2", "spelling", "anville"), ("E3", "base", "rod"), ("E3", "inflection", "rods")]


@query(f"""WITH {_TOK}, f AS (SELECT * FROM {_values(_FORMS, 'x(form, eui)')}), v AS (SELECT DISTINCT eui, variant FROM {_values(_VARIANTS, 'y(eui, kind, variant)')} WHERE kind IN ('base', 'inflection')),
l AS (SELECT *, list_extract(string_split(tok, ' '), -1) AS last FROM tok)
SELECT DISTINCT sample_id, left(tok, length(tok) - length(last)) || variant AS tok, s::INTEGER AS start, e::INTEGER AS "end" FROM l JOIN f ON last = form JOIN v USING (eui) WHERE variant <> last""")
def lexicon_variants(spark, d):
    forms = spark.createDataFrame(_FORMS, "form string, eui string")
    variants = spark.createDataFrame(_VARIANTS, "eui string, kind string, variant string")
    return K.lexicon_variants(_part_tokens(spark, d), forms, variants, ["inflection"]).select("sample_id", "tok", "start", "end")


_PROPERTY_SETS = [("P:0", 0, "red"), ("P:0", 0, "crimson"), ("P:1", 1, "small"), ("P:1", 1, "tiny"), ("P:1", 1, "little"), ("P:1", 0, "red"), ("P:1", 0, "ruddy")]


@query(f"""WITH {_TOK}, p AS (SELECT * FROM {_values(_PROPERTY_SETS, 'x(property_id, set_id, member)')})
SELECT DISTINCT sample_id, y.member AS tok, s::INTEGER AS start, e::INTEGER AS "end"
FROM tok JOIN p x ON x.member = tok AND x.property_id = 'P:' || (sample_id % 2) JOIN p y ON y.property_id = x.property_id AND y.set_id = x.set_id AND y.member <> tok""")
def property_synonyms(spark, d):
    tokens = _part_tokens(spark, d)
    keys = tokens.select("sample_id", "kv_key", "kv_value", F.concat(F.lit("P:"), (F.col("sample_id") % 2).cast("string")).alias("term_id")).distinct()
    sets = spark.createDataFrame(_PROPERTY_SETS, "property_id string, set_id int, member string")
    return K.property_synonyms(tokens, keys, sets).select("sample_id", "tok", "start", "end")


@query(f"""SELECT doc_id, md5(array_to_string([CASE WHEN regexp_matches(w, '^[A-Z].') AND NOT regexp_matches(substring(w, 2), '[A-Z]') THEN lower(substring(w, 1, 1)) || substring(w, 2) ELSE w END
FOR w IN string_split_regex(text, '{_BLANK}+') IF w <> ''], ' ')) AS digest FROM documents""")
def uncapitalized_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(T.uncapitalize(F.col("text"))).alias("digest"))


def _word_steps_sql(x: str) -> str:
    out = f"' ' || regexp_replace({x}, '{_BLANK}', ' ', 'g') || ' '"
    for pattern, to in T.WORD_STEPS:
        to = re.sub(r"\$(\d)", r"\\\1", to)
        out = "regexp_replace(" + out + ", '" + pattern.replace("'", "''") + "', '" + to.replace("'", "''") + "', 'g')"
    return f"[x FOR x IN string_split({out}, ' ') IF x <> '']"


@query(f"WITH w AS (SELECT doc_id, {_word_steps_sql('text')} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS digest FROM w")
def word_tokens_texts(spark, d):
    w = t(spark, d, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


# ---- vocabularies ----
@query(f"""WITH {_DICT}, s AS (SELECT * FROM {_SETS_SQL.format('v')}), g AS (SELECT DISTINCT term_id, y.member AS s FROM dict JOIN s x ON dict.s = x.member JOIN s y USING (set_id))
SELECT term_id, s, 'ENRICHED' AS target FROM g WHERE NOT EXISTS (SELECT 1 FROM dict k WHERE k.term_id = g.term_id AND k.s = g.s)""")
def enriched_synonyms(spark, d):
    return R.enrich_synonyms(_dictionary(spark, d), spark.createDataFrame(_SETS, "set_id int, member string")).select("term_id", "s", "target")


@query(f"WITH {_DICT} SELECT DISTINCT term_id FROM dict WHERE contains(s, 'widget') OR contains(s, 'rin')")
def keyword_terms(spark, d):
    return R.keyword_terms(_dictionary(spark, d), ["widget", "rin"])


_ASKED = [("red ring",), ("cold",), ("CL:0000010",), ("CL:x1",), ("ABC:12",), ("nothing",), ("EFO:1",)]


@query(f"""WITH {_DICT}, a AS (SELECT asked FROM {_values([f"('{x}')" for x, in _ASKED], 'v(asked)')}), n AS (SELECT DISTINCT s, term_id FROM dict WHERE target = 'TERM_NAME')
SELECT asked, term_id FROM a JOIN n ON asked = s
UNION SELECT asked, asked FROM a WHERE asked NOT IN (SELECT s FROM n) AND regexp_matches(asked, '^(DOID|UBERON|CVCL|CL|EFO):[0-9]+$')""")
def resolve_terms(spark, d):
    names = _dictionary(spark, d).where("target = 'TERM_NAME'").select(F.col("s").alias("term_name"), "term_id")
    return R.resolve_terms(names, spark.createDataFrame(_ASKED, "asked string"))


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS k, 'A:' || (s_suppkey % 10) AS l FROM supplier), b AS (SELECT DISTINCT c_custkey % 17 AS k, 'B:' || (c_custkey % 10) AS l FROM customer)
SELECT k::BIGINT AS term_id, l AS linked_id FROM b UNION SELECT k, l FROM a WHERE k NOT IN (SELECT k FROM b)""")
def link_map_update(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("term_id"), F.concat(F.lit("A:"), (F.col("s_suppkey") % 10).cast("string")).alias("linked_id"))
    b = t(spark, d, "customer").select((F.col("c_custkey") % 17).alias("term_id"), F.concat(F.lit("B:"), (F.col("c_custkey") % 10).cast("string")).alias("linked_id"))
    return R.override_links(a, b)


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def first_sample_per_study(spark, d):
    return R.first_per_group(t(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P")


@query("SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY quality, toxic")
def label_counts(spark, d):
    return t(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","confidence":"' || printf('%.2f', c_acctbal) || '"}' AS line FROM customer""")
def search_json(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.format_string("%.2f", "c_acctbal").alias("confidence"))
    return rows_as_json(rows, ["confidence", "c_mktsegment", "c_custkey"])


_CLASS_NAMES_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CLASS_NAMES.items()) + " END"


@query(f"SELECT doc_id, {_CLASS_NAMES_SQL} AS sample_type FROM (SELECT doc_id, {list(L.CLASS_NAMES)}[(doc_id % 6 + 1)::INTEGER] AS x FROM labels)")
def class_names(spark, d):
    keys = F.array(*[F.lit(k) for k in L.CLASS_NAMES])
    return t(spark, d, "labels").select("doc_id", L.class_name(F.element_at(keys, (F.col("doc_id") % 6 + 1).cast("int"))).alias("sample_type"))


# ---- graphs ----
_SUPPLIES = "SELECT DISTINCT s_nationkey::BIGINT AS src, (s_suppkey % 25)::BIGINT AS dst FROM supplier"


def _supplies(spark, d):
    return t(spark, d, "supplier").selectExpr("bigint(s_nationkey) as src", "bigint(s_suppkey % 25) as dst").distinct()


@query("SELECT p_partkey // 2 AS child, p_partkey AS parent FROM part WHERE p_partkey > 1 AND p_partkey // 2 IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def inverse_edges(spark, d):
    return G.inverse(_halves(spark, d), t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("term_id")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, (c_custkey * c_custkey + 1) % 97 AS dst FROM customer WHERE c_custkey <> (c_custkey * c_custkey + 1) % 97),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), c AS (SELECT a FROM r WHERE a = b)
SELECT src, dst FROM e WHERE src IN (SELECT a FROM c UNION SELECT b FROM r WHERE a IN (SELECT a FROM c))""")
def cycle_edges(spark, d):
    return G.on_cycles(t(spark, d, "customer").selectExpr("c_custkey as src", "(c_custkey * c_custkey + 1) % 97 as dst"))


@query(f"""WITH e AS (SELECT src, dst FROM ({_SUPPLIES}) UNION SELECT n_regionkey::BIGINT, n_nationkey::BIGINT FROM nation WHERE n_regionkey <> n_nationkey)
SELECT src, dst FROM e WHERE src % 5 <> 2 AND dst % 5 <> 2""")
def graph_edits(spark, d):
    new = t(spark, d, "nation").selectExpr("bigint(n_regionkey) as src", "bigint(n_nationkey) as dst")
    gone = t(spark, d, "nation").where("n_nationkey % 5 = 2").selectExpr("bigint(n_nationkey) as node")
    return G.delete_nodes(G.add_edges(_supplies(spark, d), new), gone)


@query("""SELECT o_custkey AS sample_id, o_orderstatus AS node, split_part(best, '|', 2) AS kv_key, split_part(best, '|', 3) AS kv_value, split_part(best, '|', 1)::INTEGER AS hops
FROM (SELECT o_custkey, o_orderstatus, min(left(o_orderpriority, 1) || '|' || o_orderpriority || '|' || (o_orderkey % 7)) AS best FROM orders GROUP BY ALL)""")
def nearest_pair(spark, d):
    paths = t(spark, d, "orders").selectExpr("o_custkey as sample_id", "o_orderstatus as node", "int(left(o_orderpriority, 1)) as hops", "o_orderpriority as kv_key", "string(o_orderkey % 7) as kv_value")
    return G.nearest_pair(paths)


@query("""WITH RECURSIVE c(term_id, ancestor) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT term_id, ancestor // 2 FROM c WHERE ancestor > 1)
SELECT p_brand AS sample_id, string_agg(DISTINCT ancestor::VARCHAR, ',' ORDER BY ancestor::VARCHAR) AS terms FROM part JOIN c ON p_partkey = term_id GROUP BY p_brand""")
def ancestor_sets(spark, d):
    mapped = t(spark, d, "part").where("p_partkey >= 1").selectExpr("p_brand as sample_id", "p_partkey as term_id")
    out = with_ancestors(mapped, _halves(spark, d))
    return out.select("sample_id", F.array_join(F.array_sort(F.expr("transform(terms, x -> string(x))")), ",").alias("terms"))


# ---- the whole plan ----
@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part),
r AS (SELECT p_partkey AS sample_id, 'PN:' || replace(p_name, ' ', '_') AS term_id, 'note' AS orig_key, 'stock of ' || p_name AS orig_value FROM part
UNION SELECT p_partkey, 'PT:' || split_part(p_name, ' ', 2), 'note', 'stock of ' || p_name FROM part
UNION SELECT p_partkey, 'PT:' || lower(p_type), 'p_type', p_type FROM part WHERE lower(p_type) IN (SELECT w FROM w))
SELECT sample_id, term_id, false AS consequent, orig_key, orig_value FROM r""")
def annotate_plan(spark, d):
    """All stages over a note with the part's name and its type; brands are blocked.

    The name is matched inside the note, its second word stays as an ancestor of the name's term, the first word and the
    synonyms by word give way to the name's interval, near names to equal ones.
    """
    p = t(spark, d, "part").withColumn("note", F.concat(F.lit("stock of "), "p_name"))
    names = _dictionary(spark, d)
    edges = names.where("term_id like 'PN:%'").select(F.col("term_id").alias("child"), F.concat(F.lit("PT:"), F.split("s", " ")[1]).alias("parent")).distinct()
    mapped, _ = annotate(spark, K.kv_pairs(p, "p_partkey", ["note", "p_type", "p_brand"]), Vocabulary(names, edges), Rules(filter_keys=["p_brand"]))
    return mapped.select("sample_id", "term_id", "consequent", "orig_key", "orig_value")
