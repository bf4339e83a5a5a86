"""The operators applied to the star-schema, event and document tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions import text as T
from termloom.functions.shared import staged
from termloom.operators import graph as G, learning as L, matching as M, relational as R, rules as U, tokens as K

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c: str):
    return F.col(c).cast("long").alias(c)


# ---- dictionaries made from the part table: words of names, with brands and types as synonyms ----
def _dictionary(spark, d):
    p = t(spark, d, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("s"))
    names = w.select("s", F.concat(F.lit("PT:"), "s").alias("term_id"), F.lit("TERM_NAME").alias("target"))
    full = p.select(F.col("p_name").alias("s"), F.concat(F.lit("PN:"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("term_id"), F.lit("TERM_NAME").alias("target"))
    kinds = p.select(F.split("p_name", " ")[1].alias("s"), F.concat(F.lit("PB:"), "p_brand").alias("term_id"), F.lit("EXACT").alias("target"))
    other = p.select(F.split("p_name", " ")[0].alias("s"), F.concat(F.lit("PT:"), F.lower("p_type")).alias("term_id"), F.lit("RELATED").alias("target"))
    return names.unionByName(full).unionByName(kinds).unionByName(other).distinct()


_DICT = """dict AS (
  SELECT DISTINCT * FROM (
    SELECT unnest(string_split(p_name, ' ')) AS s, 'PT:' || unnest(string_split(p_name, ' ')) AS term_id, 'TERM_NAME' AS target FROM part
    UNION ALL SELECT p_name, 'PN:' || replace(p_name, ' ', '_'), 'TERM_NAME' FROM part
    UNION ALL SELECT string_split(p_name, ' ')[2], 'PB:' || p_brand, 'EXACT' FROM part
    UNION ALL SELECT string_split(p_name, ' ')[1], 'PT:' || lower(p_type), 'RELATED' FROM part)
)"""
_MATCH = (
    _DICT
    + """, asked AS (SELECT DISTINCT p_name AS tok FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
hits AS (SELECT DISTINCT tok, term_id, target FROM asked JOIN dict ON tok = s WHERE length(tok) >= 3),
exact AS (
  SELECT tok, term_id, CASE WHEN target = 'TERM_NAME' THEN target ELSE target || '_SYNONYM' END AS label
  FROM (SELECT *, bool_or(target = 'TERM_NAME') OVER (PARTITION BY tok, term_id) AS named FROM hits)
  WHERE NOT named OR target = 'TERM_NAME')"""
)


def _part_tokens(spark, d):
    """Names of parts and their words, as tokens with intervals."""
    kv = K.kv_pairs(t(spark, d, "part"), "p_partkey", ["p_name"])
    base = K.init_tokens(kv).where("side = 'val'")
    return base.unionByName(K.ngrams(base))


_TOK = """tok AS (
  SELECT p_partkey AS sample_id, p_name AS tok, 6 AS s, 6 + length(p_name) AS e FROM part
  UNION ALL SELECT p_partkey, string_split(p_name, ' ')[1], 6, 6 + length(string_split(p_name, ' ')[1]) FROM part
  UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2], 7 + length(string_split(p_name, ' ')[1]), 6 + length(p_name) FROM part
)"""


def _matches(spark, d):
    tok = _part_tokens(spark, d)
    return tok.join(M.exact_match(tok, _dictionary(spark, d)), "tok").select("sample_id", "tok", "start", "end", "term_id", "label")


@query("""
WITH d AS (SELECT doc_id, string_split(trim(lower(regexp_replace(text, '[^0-9a-zA-Z]+', ' ', 'g'))), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(lower(regexp_replace(text, '[^0-9a-zA-Z]+', ' ', 'g'))), ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM d),
bg AS (SELECT DISTINCT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM b)
SELECT gram, count(*)::BIGINT AS n_docs FROM dg JOIN bg USING (gram) GROUP BY gram""")
def exact_match_bigrams(spark, d):
    def grams(df, key):
        w = df.select(key, F.split(F.trim(F.lower(F.regexp_replace("text", "[^0-9a-zA-Z]+", " "))), " ").alias("w"))
        return w.where("size(w) >= 2").select(key, F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))"))).alias("gram"))

    wanted = staged(grams(t(spark, d, "benchmark"), "item_id").select("gram").distinct(), "wanted-bigrams")  # of known size: small ones are broadcast
    return grams(t(spark, d, "documents"), "doc_id").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n_docs"))


@query("SELECT event_id AS sample_id, 'event_type' AS kv_key, event_type AS kv_value FROM events WHERE event_type NOT IN ('error', 'signup')")
def kv_blocklist_filter(spark, d):
    return K.block_pairs(K.kv_pairs(t(spark, d, "events"), "event_id", ["event_type"]), ["project"], ["error", "signup"])


@query("""
WITH kv AS (SELECT p_partkey AS sample_id, unnest(['p_name', 'p_brand', 'p_type']) AS k, unnest([p_name, p_brand, p_type]) AS v FROM part),
o AS (SELECT *, coalesce(sum(length(k) + length(v)) OVER (PARTITION BY sample_id ORDER BY k, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS a FROM kv)
SELECT sample_id, k AS tok, a AS start, (a + length(k))::INTEGER AS "end", k AS kv_key, v AS kv_value, 'key' AS side FROM o
UNION ALL SELECT sample_id, v, (a + length(k))::INTEGER, (a + length(k) + length(v))::INTEGER, k, v, 'val' FROM o""")
def kv_init_offsets(spark, d):
    return K.init_tokens(K.kv_pairs(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"]))


@query("""
WITH w AS (SELECT c_custkey AS sample_id, string_split(c_name || ' of ' || lower(c_mktsegment) || ' nation ' || c_nationkey, ' ') AS w FROM (SELECT c_custkey, replace(c_name, '#', ' ') AS c_name, c_mktsegment, c_nationkey FROM customer)),
g AS (SELECT sample_id, w, unnest(generate_series(1, least(8, len(w)) - 1)) AS n FROM w),
i AS (SELECT sample_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM g)
SELECT sample_id, array_to_string(w[i:i + n - 1], ' ') AS tok, (5 + length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END)::INTEGER AS start,
       (5 + length(array_to_string(w[1:i + n - 1], ' ')))::INTEGER AS "end" FROM i""")
def token_ngrams(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.concat_ws(" ", F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("of"), F.lower("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("notes"))
    return K.ngrams(K.init_tokens(K.kv_pairs(c, "c_custkey", ["notes"])).where("side = 'val'")).select("sample_id", "tok", "start", "end")


@query("""
SELECT tok, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df
FROM (SELECT doc_id, unnest(string_split(trim(lower(regexp_replace(text, '[^0-9a-zA-Z]+', ' ', 'g'))), ' ')) AS tok FROM documents) WHERE tok <> '' GROUP BY tok""")
def token_lowercase_counts(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.explode(F.split(F.trim(F.lower(F.regexp_replace("text", "[^0-9a-zA-Z]+", " "))), " ")).alias("tok")).where("tok <> ''")
    return w.groupBy("tok", "doc_id").count().groupBy("tok").agg(F.sum("count").cast("long").alias("tf"), F.count("*").alias("df"))


def _delimit_sql(x, table, key, name, delim):
    base = len(name)
    return f"""SELECT {key} AS sample_id, p AS tok, ({base} + coalesce(list_sum([length(q) + 1 for q in ps[1:i - 1]]), 0))::INTEGER AS start,
  ({base} + coalesce(list_sum([length(q) + 1 for q in ps[1:i - 1]]), 0) + length(p))::INTEGER AS "end"
  FROM (SELECT {key}, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT {key}, string_split({x}, '{delim}') AS ps FROM {table} WHERE contains({x}, '{delim}')))"""


@query(_delimit_sql("c_name", "customer", "c_custkey", "c_name", "#") + " UNION ALL " + _delimit_sql("o_orderpriority || '-'", "orders", "o_orderkey", "note", "-"))
def delimit_tokens(spark, d):
    a = K.delimit(K.init_tokens(K.kv_pairs(t(spark, d, "customer"), "c_custkey", ["c_name"])), "#")
    o = t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("-")).alias("note"))
    b = K.delimit(K.init_tokens(K.kv_pairs(o, "o_orderkey", ["note"])), "-")
    return a.unionByName(b).select("sample_id", "tok", "start", "end")


@query(f"WITH {_MATCH}, {_TOK} SELECT term_id, count(DISTINCT sample_id)::BIGINT AS n_samples FROM tok JOIN exact USING (tok) GROUP BY term_id")
def exact_match(spark, d):
    return _matches(spark, d).groupBy("term_id").agg(F.count_distinct("sample_id").alias("n_samples"))


@query(f"WITH {_MATCH} SELECT tok, term_id, label FROM exact")
def exact_match_labels(spark, d):
    return M.exact_match(_part_tokens(spark, d).select("tok"), _dictionary(spark, d))


@query("""
WITH q AS (SELECT replace(s_name, '#', '-') AS tok FROM supplier UNION SELECT left(s_name, length(s_name) - 1) FROM supplier), s AS (SELECT s_name AS s FROM supplier),
p AS (SELECT tok, s, levenshtein(tok, s) AS e FROM q, s), f AS (SELECT * FROM p WHERE e <= 2 AND e / greatest(length(tok), length(s)) <= 0.1)
SELECT tok, s, e::INTEGER AS edit_dist FROM (SELECT *, min(e) OVER (PARTITION BY tok) AS b FROM f) WHERE e = b""")
def fuzzy_match_best(spark, d):
    """Names with another sign, and without their last digit (ten of them are as near), among all names."""
    s = t(spark, d, "supplier").select(F.col("s_name").alias("s"))
    asked = s.select(F.replace("s", F.lit("#"), F.lit("-")).alias("tok")).unionByName(s.select(F.expr("left(s, length(s) - 1)").alias("tok")))
    return M.fuzzy_match(asked, s)


@query("""
WITH p AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT a, b, unnest(list_distinct(string_split(a || b, ''))) AS x FROM p),
n AS (SELECT a, b, length(a) - length(replace(a, x, '')) - length(b) + length(replace(b, x, '')) AS d FROM c)
SELECT a, b, greatest(sum(greatest(d, 0)), sum(greatest(-d, 0)))::INTEGER AS distance FROM n GROUP BY a, b""")
def bag_distance(spark, d):
    p = t(spark, d, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("a", "b").distinct()
    return pairs.select("a", "b", T.char_counts_distance(F.col("a"), F.col("b")).alias("distance"))


_SETS = [(0, "red"), (0, "crimson"), (0, "scarlet"), (1, "small"), (1, "tiny"), (2, "ring"), (2, "hoop")]
_SETS_SQL = "(VALUES " + ", ".join(f"({a}, '{b}')" for a, b in _SETS) + ") {}(set_id, member)"


@query(f"""WITH {_TOK} SELECT DISTINCT tok.sample_id, y.member AS tok, s::INTEGER AS start, e::INTEGER AS "end"
FROM tok JOIN {_SETS_SQL.format('x')} ON tok.tok = x.member JOIN {_SETS_SQL.format('y')} ON x.set_id = y.set_id AND x.member <> y.member""")
def synonym_expand(spark, d):
    return K.expand_sets(_part_tokens(spark, d), spark.createDataFrame(_SETS, "set_id int, member string")).select("sample_id", "tok", "start", "end")


_ACRONYMS = {"SML": ["small size", "size"], "LRG": ["large size"], "rdw": ["red widget", "widget"], "HOT": ["hot rolled"]}
_ACR = [(k, v) for k, vs in _ACRONYMS.items() for v in vs]
_ACR_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ACR) + ") m(a, b)"


@query(f"""SELECT p_partkey AS sample_id, b AS tok FROM (SELECT p_partkey, ['SML', 'LRG', 'rdw', 'RDW', 'HOT', 'hot', 'other'][(p_size % 7 + 1)::INTEGER] AS x FROM part) JOIN {_ACR_SQL} ON x = a""")
def acronym_expand(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.expr("element_at(array('SML', 'LRG', 'rdw', 'RDW', 'HOT', 'hot', 'other'), int(p_size % 7 + 1))").alias("note"))
    tok = K.init_tokens(K.kv_pairs(p, "p_partkey", ["note"])).where("side = 'val'")
    return K.expand_map(tok, spark.createDataFrame(_ACR, "from_str string, to_str string")).select("sample_id", "tok")


@query(r"""
WITH x AS (SELECT p_partkey AS sample_id, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_size::VARCHAR END || ['h', 'hr', 'mo', 'd', 'min', 'hrs', ' h'][(p_partkey % 7 + 1)::INTEGER] AS s FROM part),
m AS (SELECT sample_id, regexp_extract(s, '^([0-9]*)\s*(h|hr|mo|d|min)$', 1) AS n, regexp_extract(s, '^([0-9]*)\s*(h|hr|mo|d|min)$', 2) AS u FROM x)
SELECT sample_id, CASE WHEN n = '' THEN NULL ELSE n END AS number, u AS unit,
  CASE u WHEN 'h' THEN 'hour' WHEN 'hr' THEN 'hour' WHEN 'mo' THEN 'month' WHEN 'd' THEN 'day' ELSE 'minute' END AS expanded FROM m WHERE u <> ''""")
def parse_time_unit(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.expr("concat(case when p_size % 9 = 0 then '' else string(p_size) end, element_at(array('h', 'hr', 'mo', 'd', 'min', 'hrs', ' h'), int(p_partkey % 7 + 1)))").alias("s"))
    return x.select("sample_id", T.time_and_unit(F.col("s")).alias("u")).where("u is not null").select("sample_id", "u.number", "u.unit", "u.expanded")


_NUMS = ["1", "1.5", "-2", "+3", "1e5", ".5", "5.", "12d", "5f", "1_000", "abc", "", " 12 ", "1__0", "0x1", "--1", "1e", "7_", "12.5.1"]


@query("SELECT s, ok, CASE WHEN ok THEN replace(trim(s), '_', '')::DOUBLE END AS value FROM (SELECT s, regexp_full_match(s, '\\s*[+-]?((\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+(_\\d+)*)?)\\s*') AS ok FROM (VALUES " + ", ".join(f"('{x}')" for x in _NUMS) + ") v(s) UNION ALL SELECT p_name, false FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT DISTINCT p_size::VARCHAR || 's', false FROM part)")
def is_number_guarded(spark, d):
    p = t(spark, d, "part")
    s = spark.createDataFrame([(x,) for x in _NUMS], "s string").unionByName(p.select(F.col("p_name").alias("s")).distinct()).unionByName(p.select(F.concat(F.col("p_size").cast("string"), F.lit("s")).alias("s")).distinct())
    return s.select("s", T.is_number(F.col("s")).alias("ok"), T.to_number(F.col("s")).alias("value"))


@query("""
WITH m AS (SELECT o_custkey AS sample_id, (o_orderkey % 3)::INTEGER AS start, (o_orderkey % 3 + 4)::INTEGER AS "end", 'T:' || (o_orderkey % 11) AS term_id, (o_orderkey % 4 // 2)::INTEGER AS edit_dist FROM orders)
SELECT DISTINCT sample_id, start, "end", term_id, edit_dist FROM (SELECT *, min(edit_dist) OVER (PARTITION BY sample_id, start, "end") AS l FROM m) WHERE edit_dist = 0 OR l > 0""")
def exact_over_fuzzy(spark, d):
    m = t(spark, d, "orders").selectExpr("o_custkey as sample_id", "int(o_orderkey % 3) as start", "int(o_orderkey % 3 + 4) as end", "concat('T:', o_orderkey % 11) as term_id", "int(o_orderkey % 4 div 2) as edit_dist").distinct()
    return U.exact_over_fuzzy(m)


@query(f"""WITH {_MATCH}, {_TOK}, m AS (SELECT sample_id, tok, s::INTEGER AS start, e::INTEGER AS "end", term_id, label, label IN ('TERM_NAME', 'EXACT_SYNONYM', 'ENRICHED_SYNONYM') AS direct FROM tok JOIN exact USING (tok))
SELECT sample_id, tok, start, "end", term_id, label FROM (SELECT *, bool_or(direct) OVER (PARTITION BY sample_id, tok, start, "end", split_part(term_id, ':', 1)) AS any_direct FROM m) WHERE direct OR NOT any_direct""")
def direct_over_indirect(spark, d):
    return U.direct_over_indirect(_matches(spark, d))


@query(f"""WITH {_MATCH}, {_TOK}, m AS (SELECT DISTINCT sample_id, s::INTEGER AS start, e::INTEGER AS "end", term_id FROM tok JOIN exact USING (tok))
SELECT a.* FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.sample_id = a.sample_id AND b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end"))""")
def subinterval_block(spark, d):
    return U.drop_contained(_matches(spark, d).select("sample_id", "start", "end", "term_id").distinct())


@query(f"""WITH {_MATCH}, {_TOK}, m AS (SELECT DISTINCT sample_id, tok, term_id FROM tok JOIN exact USING (tok)),
s AS (SELECT sample_id % 500 AS sample_id, sample_id AS part, tok, term_id FROM m), ok AS (SELECT p_partkey AS part FROM part WHERE p_type = 'PROMO'),
bad AS (SELECT sample_id, term_id FROM s WHERE split_part(term_id, ':', 1) = 'PN' GROUP BY ALL HAVING NOT bool_or(part IN (SELECT part FROM ok)))
SELECT sample_id::BIGINT AS sample_id, part::VARCHAR AS kv_value, term_id FROM s WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sample_id = s.sample_id AND bad.term_id = s.term_id) GROUP BY ALL""")
def context_block(spark, d):
    m = _matches(spark, d).selectExpr("sample_id % 500 as sample_id", "'part' as kv_key", "string(sample_id) as kv_value", "term_id").distinct()
    ok = t(spark, d, "part").where("p_type = 'PROMO'").selectExpr("p_partkey % 500 as sample_id", "'part' as kv_key", "string(p_partkey) as kv_value")
    blocked = m.where("term_id like 'PN:%'").select("term_id").distinct()
    return U.licensed(m, blocked, ok).select("sample_id", "kv_value", "term_id")


@query("""
SELECT DISTINCT user_id AS sample_id, t AS term_id FROM events, (VALUES ('EFO:0001272'), ('UBERON:0007023')) v(t) WHERE event_type = 'view' AND value > 18
UNION SELECT DISTINCT user_id, t FROM events, (VALUES ('CL:0000010'), ('EFO_BTO:0000214')) v(t) WHERE event_type = 'click'""")
def derived_terms_by_rule(spark, d):
    e = t(spark, d, "events")
    values = e.select(F.col("user_id").alias("sample_id"), F.when(F.col("event_type") == "view", "EFO:0000246").otherwise("other").alias("property_id"), F.lit("UO:0000036").alias("unit_id"), "value")
    terms = e.select(F.col("user_id").alias("sample_id"), F.when(F.col("event_type") == "click", "CVCL:1").otherwise("X:1").alias("term_id"))
    return U.adult_terms(values).unionByName(U.namespace_terms(terms)).distinct()


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT greatest(1, ceil(count(*) / 100.0))::BIGINT FROM orders))::BIGINT AS chunk FROM orders")
def shard_chunks(spark, d):
    return R.shards(t(spark, d, "orders"), "o_orderkey", 100)


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS sample_id, l_returnflag AS x FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS sample_id, l_linestatus || l_linenumber AS y FROM lineitem)
SELECT sample_id, 'r1' AS rule FROM t WHERE x = 'A' AND sample_id IN (SELECT sample_id FROM a WHERE y IN ('F1', 'O1')) AND sample_id IN (SELECT sample_id FROM a WHERE y = 'F2')
UNION ALL SELECT sample_id, 'r2' FROM t WHERE x = 'R' AND sample_id IN (SELECT sample_id FROM t WHERE x = 'N') AND sample_id IN (SELECT sample_id FROM a WHERE y = 'O3')
UNION ALL SELECT sample_id, 'r3' FROM t WHERE x = 'N'""")
def rule_combos(spark, d):
    li = t(spark, d, "lineitem")
    terms = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("term_id")).distinct()
    artifacts = li.select(F.col("l_orderkey").alias("sample_id"), F.concat("l_linestatus", "l_linenumber").alias("tok")).distinct()
    need_t = spark.createDataFrame([("r1", "A"), ("r2", "R"), ("r2", "N"), ("r3", "N")], "rule string, term_id string")
    need_a = spark.createDataFrame([("r1", 0, "F1"), ("r1", 0, "O1"), ("r1", 1, "F2"), ("r2", 0, "O3")], "rule string, set_no int, tok string")
    return U.combinations(terms, artifacts, need_t, need_a)


@query("""
WITH e AS (SELECT event_id AS sample_id, event_type, json_extract_string(props, '$.k')::DOUBLE AS value FROM events)
SELECT sample_id, CASE WHEN event_type IN ('view', 'click') THEN 'EFO:0000246' ELSE 'EFO:0007061' END AS property_id, value,
  CASE event_type WHEN 'view' THEN 'UO:0000036' WHEN 'click' THEN 'missing' WHEN 'purchase' THEN 'UO:0000189' ELSE NULL END AS unit_id FROM e WHERE event_type <> 'error'""")
def real_value_extract(spark, d):
    e = t(spark, d, "events").selectExpr("event_id as sample_id", "event_type as kv_key", "props as kv_value", "event_type", "cast(get_json_object(props, '$.k') as double) as value")
    pair = ["sample_id", "kv_key", "kv_value"]
    props = e.select(*pair, F.explode(F.expr("case when event_type in ('view', 'click') then array('EFO:0000246') when event_type = 'error' then array('EFO:0000246', 'EFO:0007061') else array('EFO:0007061') end")).alias("property_id"))
    units = e.select(*pair, F.explode(F.expr("case event_type when 'view' then array('UO:0000036') when 'signup' then array('UO:0000036', 'UO:0000033') else array() end")).alias("unit_id"))
    default = spark.createDataFrame([("EFO:0007061", "UO:0000189")], "property_id string, default_unit string")
    return U.real_values(props, e.select(*pair, "value"), units, default).select("sample_id", "property_id", "value", "unit_id")


def _halves(spark, d):
    p = t(spark, d, "part").where("p_partkey > 1")
    return p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


@query("""WITH RECURSIVE c(term_id, ancestor) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT term_id, ancestor // 2 FROM c WHERE ancestor > 1) SELECT term_id, ancestor FROM c""")
def closure_ancestors(spark, d):
    return G.closure_of_all(_halves(spark, d), t(spark, d, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("term_id")))


@query("""WITH RECURSIVE c(x) AS (SELECT unnest([3, 10])::BIGINT UNION SELECT p_partkey FROM part, c WHERE p_partkey > 1 AND p_partkey // 2 = x)
SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 AND p_partkey IN (SELECT x FROM c) AND p_partkey // 2 IN (SELECT x FROM c)""")
def subtree_restrict(spark, d):
    roots = spark.createDataFrame([(3,), (10,)], "term_id long")
    return G.restrict(_halves(spark, d), G.subtree(_halves(spark, d), roots))


@query("""WITH RECURSIVE c(term_id, ancestor) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT term_id, ancestor // 2 FROM c WHERE ancestor > 1),
m AS (SELECT DISTINCT p_brand AS set_id, p_partkey AS term_id FROM part WHERE p_partkey >= 1)
SELECT set_id, term_id FROM m WHERE NOT EXISTS (SELECT 1 FROM m k JOIN c ON c.term_id = k.term_id WHERE k.set_id = m.set_id AND c.ancestor = m.term_id AND c.term_id <> m.term_id)""")
def most_specific(spark, d):
    p = t(spark, d, "part").where("p_partkey >= 1")
    return G.most_specific(p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("term_id")).distinct(), G.closure_of_all(_halves(spark, d), p.select(F.col("p_partkey").alias("term_id"))))


# ---- a graph on all customers: each follows from a third of its number, in shortcuts from a ninth ----
_STEPS_SQL = """e AS (SELECT c_custkey // 3 AS src, c_custkey AS dst, c_mktsegment AS label FROM customer WHERE c_custkey > 0
  UNION SELECT c_custkey // 9, c_custkey, 'shortcut' FROM customer WHERE c_custkey // 9 % 2 = 1)"""


def _steps(spark, d):
    c = t(spark, d, "customer")
    return c.where("c_custkey > 0").selectExpr("c_custkey div 3 as src", "c_custkey as dst", "c_mktsegment as label").unionByName(
        c.where("c_custkey div 9 % 2 = 1").selectExpr("c_custkey div 9 as src", "c_custkey as dst", "'shortcut' as label")
    )


@query(f"""WITH RECURSIVE {_STEPS_SQL},
h(source, node, hops) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation UNION SELECT source, dst, hops + 1 FROM h JOIN e ON node = src WHERE hops < 40)
SELECT source, node, min(hops)::INTEGER AS hops FROM h GROUP BY source, node""")
def shortest_hops(spark, d):
    return G.shortest_hops(_steps(spark, d), t(spark, d, "nation").selectExpr("bigint(n_nationkey) as source"))


@query(f"""WITH RECURSIVE {_STEPS_SQL}, h(source, node, hops, path) AS (
  SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0, [n_nationkey::BIGINT] FROM nation UNION ALL SELECT source, dst, hops + 1, list_append(path, dst) FROM h JOIN (SELECT DISTINCT src, dst FROM e) ON node = src WHERE hops < 40)
SELECT source, node, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY hops, path) AS r FROM h) WHERE r = 1""")
def shortest_paths(spark, d):
    found = G.shortest_paths(_steps(spark, d), t(spark, d, "nation").selectExpr("bigint(n_nationkey) as source"))
    return found.select("source", "node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {_DICT} SELECT DISTINCT b.term_id AS b_id, a.term_id AS a_id FROM dict a JOIN dict b ON a.s = b.s WHERE a.target IN ('TERM_NAME', 'EXACT') AND b.target IN ('TERM_NAME', 'EXACT') AND a.term_id LIKE 'PT:%' AND b.term_id LIKE 'PB:%'")
def cross_link_terms(spark, d):
    x = _dictionary(spark, d)
    return R.linked_terms(x.where("term_id like 'PT:%'"), x.where("term_id like 'PB:%'"))


@query(f"""WITH {_DICT}, a AS (SELECT DISTINCT s, term_id FROM dict WHERE term_id LIKE 'PT:%'), b AS (SELECT DISTINCT s, term_id FROM dict WHERE term_id LIKE 'PN:%')
SELECT DISTINCT b.term_id AS b_id, a.term_id AS a_id FROM a, b WHERE length(a.s) > 2 AND length(b.s) > 2 AND a.s <> b.s AND contains(b.s, a.s)
AND len(list_filter(string_split(a.s, ' '), lambda w: NOT list_contains(string_split(b.s, ' '), w))) = 0 AND b.term_id NOT IN (SELECT b2.term_id FROM b b2 JOIN a a2 ON a2.s = b2.s)""")
def implication_subset(spark, d):
    x = _dictionary(spark, d)
    return R.implications(x.where("term_id like 'PT:%'"), x.where("term_id like 'PN:%'"))


_SUB = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"


@query(f"SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SUB}")
def subset_join_sample(spark, d):
    return t(spark, d, "orders").where(_SUB).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name", "c_mktsegment")


@query(f"SELECT n_nationkey, n_name, count(*)::BIGINT AS n FROM nation JOIN (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SUB}) ON n_nationkey = c_nationkey GROUP BY ALL")
def subset_join_study(spark, d):
    s = t(spark, d, "orders").where(_SUB).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return t(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "n")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SUB})")
def subset_join_run(spark, d):
    s = t(spark, d, "orders").where(_SUB).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t(spark, d, "lineitem").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


def _searched(spark, d, kind):
    li, s = t(spark, d, "lineitem"), t(spark, d, "supplier")
    terms = li.select(F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("P:"), "l_partkey").alias("term_id"))
    return R.search(terms, s.select(F.col("s_suppkey").alias("sample_id"), "s_name"), s.select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").cast("string").alias("sample_type"), F.col("s_acctbal").alias("confidence")), "P:7", kind)


@query("SELECT DISTINCT s_suppkey AS sample_id, s_name, s_nationkey::VARCHAR AS sample_type, s_acctbal AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7")
def search_term(spark, d):
    return _searched(spark, d, "all")


@query("SELECT DISTINCT s_suppkey AS sample_id, s_name, s_nationkey::VARCHAR AS sample_type, s_acctbal AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7 AND s_nationkey = (SELECT min(s_nationkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7)")
def search_term_by_type(spark, d):
    low = _searched(spark, d, None).agg(F.min(F.col("sample_type").cast("int"))).first()[0]
    return _searched(spark, d, str(low))


@query("SELECT DISTINCT s_suppkey::VARCHAR || chr(9) || s_name || chr(9) || s_nationkey::VARCHAR || chr(9) || printf('%.3f', s_acctbal) AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7")
def search_tsv(spark, d):
    from termloom.sources.readers import rows_as_tsv

    return rows_as_tsv(_searched(spark, d, None), ["sample_id", "s_name", "sample_type", "confidence"], "confidence")


@query("SELECT user_id, arg_max(event_id, event_id)::BIGINT AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_last_wins(spark, d):
    return R.last_wins(t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("""
WITH r AS (SELECT p_partkey AS sample_id, 'name: ' || p_name || ' || brand: ' || p_brand || ':x || junk || size: ' || p_size || ' || name: ' || p_type AS raw FROM part)
SELECT sample_id, 'name' AS tag, trim(string_split(string_split(raw, '||')[5], ':')[2]) AS value FROM r
UNION ALL SELECT sample_id, 'brand', trim(string_split(string_split(raw, '||')[2], ':')[2]) FROM r
UNION ALL SELECT sample_id, 'size', trim(string_split(string_split(raw, '||')[4], ':')[2]) FROM r""")
def attr_string_parse(spark, d):
    raw = F.concat(F.lit("name: "), "p_name", F.lit(" || brand: "), "p_brand", F.lit(":x || junk || size: "), "p_size", F.lit(" || name: "), "p_type")
    return R.tagged_pairs(t(spark, d, "part").withColumnRenamed("p_partkey", "sample_id"), "sample_id", raw)


@query("""
SELECT p_partkey AS sample_id, i AS read_index, CASE WHEN i = 0 THEN 'Application Read' ELSE 'Technical Read' END AS read_class, CASE WHEN i = 0 THEN 'Forward' END AS read_type, (CASE WHEN i = 0 THEN 1 ELSE p_size END)::INTEGER AS base_coord
FROM part, (VALUES (0), (1)) v(i)""")
def read_spec_parse(spark, d):
    raw = F.concat(F.lit("READ_INDEX: 0; READ_CLASS: Application Read; READ_TYPE: Forward; BASE_COORD: 1 || READ_INDEX: 1; READ_CLASS: Technical Read; BASE_COORD: "), "p_size")
    return R.read_spec(t(spark, d, "part").withColumnRenamed("p_partkey", "sample_id"), "sample_id", raw)


@query("SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS layout FROM orders")
def layout_parse(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.library_layout(F.col("o_orderpriority")).alias("layout"))


@query("""SELECT o_custkey AS sample_id, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'human' WHEN bool_or(o_orderstatus = 'P') THEN 'rat' ELSE 'mouse' END AS species,
  CASE WHEN bool_or(o_orderstatus = 'O') THEN 'rna' WHEN bool_or(o_orderstatus = 'P') THEN 'array' ELSE 'chip' END AS assay FROM orders GROUP BY o_custkey""")
def union_assays(spark, d):
    o = t(spark, d, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("sample_id")).distinct()
    return R.union_sources({("mouse", "chip"): part("F"), ("rat", "array"): part("P"), ("human", "rna"): part("O")}, ("species", "assay"), ["sample_id"])


@query("""SELECT event_type, count(*) FILTER (WHERE event_id % 10 <> 3)::BIGINT AS good, count(*) FILTER (WHERE event_id % 10 = 3)::BIGINT AS bad FROM events GROUP BY event_type""")
def gather_with_rejects(spark, d):
    e = t(spark, d, "events").select("event_type", F.when(F.col("event_id") % 10 == 3, F.expr("substring(props, 2)")).otherwise(F.col("props")).alias("j"))
    ok = F.from_json("j", "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNull()
    return e.withColumn("ok", ok).groupBy("event_type").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


_GRAMS = """w AS (SELECT doc_id AS sample_id, list_filter(string_split(trim(lower(regexp_replace(text, '[^0-9a-zA-Z]+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT sample_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM w)"""


def _grams(documents):
    x = documents.select("doc_id", F.trim(F.lower(F.regexp_replace("text", "[^0-9a-zA-Z]+", " "))).alias("x"))
    return L.classifier_grams(x, "doc_id", "x")


@query(f"WITH {_GRAMS} SELECT gram, count(*)::BIGINT AS tf, count(DISTINCT sample_id)::BIGINT AS df FROM g WHERE length(gram) > 1 GROUP BY gram HAVING count(DISTINCT sample_id) > 2")
def doc_freq_vocab(spark, d):
    return L.vocabulary(_grams(t(spark, d, "documents")))


_MI = f"""{_GRAMS}, l AS (SELECT doc_id AS sample_id, (quality * 2 + toxic)::VARCHAR AS label FROM labels), n AS (SELECT count(*)::DOUBLE AS n FROM l),
t AS (SELECT g.* FROM g WHERE sample_id IN (SELECT sample_id FROM l)), v AS (SELECT gram FROM t WHERE length(gram) > 1 GROUP BY gram HAVING count(DISTINCT sample_id) > 2),
p AS (SELECT DISTINCT sample_id, gram FROM t JOIN v USING (gram)), m AS (SELECT * FROM p JOIN l USING (sample_id)),
ng AS (SELECT gram, count(*)::DOUBLE AS ng FROM m GROUP BY gram), nl AS (SELECT label, count(*)::DOUBLE AS nl FROM l GROUP BY label), nb AS (SELECT gram, label, count(*)::DOUBLE AS nb FROM m GROUP BY ALL),
mi AS (SELECT ng.gram, nl.label,
  CASE WHEN coalesce(nb, 0) > 0 THEN nb / n * ln(nb * n / (ng * nl)) ELSE 0 END + CASE WHEN ng - coalesce(nb, 0) > 0 THEN (ng - coalesce(nb, 0)) / n * ln((ng - coalesce(nb, 0)) * n / (ng * (n - nl))) ELSE 0 END
  + CASE WHEN nl - coalesce(nb, 0) > 0 THEN (nl - coalesce(nb, 0)) / n * ln((nl - coalesce(nb, 0)) * n / ((n - ng) * nl)) ELSE 0 END
  + CASE WHEN n - ng - nl + coalesce(nb, 0) > 0 THEN (n - ng - nl + coalesce(nb, 0)) / n * ln((n - ng - nl + coalesce(nb, 0)) * n / ((n - ng) * (n - nl))) ELSE 0 END AS mi
  FROM n, ng CROSS JOIN nl LEFT JOIN nb ON ng.gram = nb.gram AND nl.label = nb.label)"""


def _mi(spark, d):
    """Of the training set, the labelled documents: grams in more than two of them."""
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") * 2 + F.col("toxic")).cast("string").alias("label"))
    texts = t(spark, d, "documents").join(labels.select(F.col("sample_id").alias("doc_id")), "doc_id", "left_semi")
    return L.mutual_information(_grams(texts).distinct(), labels, above=2)


@query(f"WITH {_MI} SELECT gram, label, round(mi, 9) + 0.0 AS mi FROM mi")
def mi_feature_rank(spark, d):
    return _mi(spark, d).select("gram", "label", (F.round("mi", 9) + 0.0).alias("mi"))


@query(f"WITH {_MI} SELECT label, gram, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mi DESC, gram DESC) AS rank FROM (SELECT gram, label, round(mi, 9) AS mi FROM mi)) WHERE rank <= 75")
def top_features_per_class(spark, d):
    return L.top_features(_mi(spark, d).withColumn("mi", F.round("mi", 9))).select("label", "gram", "rank")


_KINDS = list(L.KIND_CLASSES)
_ALLOWED_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.KIND_CLASSES.items()) + " END"


@query(f"""
WITH s AS (SELECT doc_id AS sample_id, c AS label, ((doc_id * 7 + i * 13) % 10)::DOUBLE AS confidence
  FROM labels, (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(L.CLASS_NAMES))}) v(c, i)),
f AS (SELECT doc_id AS sample_id, doc_id % 11 = 0 AS xenograft, doc_id % 5 = 0 AS stem, doc_id % 3 = 0 AS specific, doc_id % 7 = 0 AS prim, toxic = 1 OR doc_id % 4 = 0 AS passaged, (toxic = 1 OR doc_id % 4 = 0) AND doc_id % 8 <> 0 AS divided,
  CASE WHEN doc_id % 6 = 0 THEN {_KINDS}[(doc_id % 9 + 1)::INTEGER] END AS kind FROM labels),
x AS (SELECT s.*, f.* EXCLUDE (sample_id), {_ALLOWED_SQL} AS allowed FROM s JOIN f USING (sample_id)),
r AS (SELECT sample_id, label, CASE WHEN xenograft THEN CASE WHEN label = 'tissue' THEN confidence ELSE 0 END
  WHEN passaged AND label = 'tissue' THEN 0 WHEN divided AND label = 'primary_cells' THEN 0
  WHEN kind IS NOT NULL THEN CASE WHEN list_contains(allowed, label) THEN confidence ELSE 0 END
  WHEN stem AND label IN ('cell_line', 'tissue', 'primary_cells') THEN 0 WHEN NOT stem AND specific AND label = 'tissue' THEN 0
  WHEN prim AND NOT passaged AND label NOT IN ('primary_cells', 'stem_cells') THEN 0 ELSE confidence END AS confidence FROM x),
n AS (SELECT sample_id, label, CASE WHEN sum(confidence) OVER (PARTITION BY sample_id) > 0 THEN confidence / sum(confidence) OVER (PARTITION BY sample_id) ELSE 0.0 END AS confidence FROM r)
SELECT sample_id, label, round(confidence, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, label) AS r FROM n) WHERE r = 1""")
def class_rules_argmax(spark, d):
    lab = t(spark, d, "labels").withColumnRenamed("doc_id", "sample_id")
    classes = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(i).alias("i")) for i, c in enumerate(L.CLASS_NAMES)])
    scores = lab.select("sample_id", F.inline(classes)).select("sample_id", "label", ((F.col("sample_id") * 7 + F.col("i") * 13) % 10).cast("double").alias("confidence"))
    given = [(11, L.XENOGRAFT), (5, L.STEM_CELL), (3, L.SPECIFIC_CELL), (7, L.PRIMARY_CELL)]
    ids = F.array(*[F.when(F.col("sample_id") % k == 0, term) for k, term in given], F.when(F.col("sample_id") % 6 == 0, F.concat(F.lit("CVCL:"), (F.col("sample_id") % 9).cast("string"))))
    terms = lab.select("sample_id", F.explode(ids).alias("term_id")).where("term_id is not null")
    values = lab.where("toxic = 1 or sample_id % 4 = 0").select("sample_id", F.lit(L.PASSAGE).alias("property_id"), F.when(F.col("sample_id") % 8 == 0, 0.0).otherwise(2.0).alias("value"), F.lit(L.PASSAGE_UNIT).alias("unit_id"))
    kinds = spark.createDataFrame([(f"CVCL:{i}", k) for i, k in enumerate(_KINDS)], "term_id string, subset string")
    return L.normalized_best(L.rule_scores(scores, L.rule_facts(terms, values, kinds))).select("sample_id", "label", F.round("confidence", 9).alias("confidence"))


@query()
def sample_type_predict(spark, d):
    grams = _grams(t(spark, d, "documents"))
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("label"))
    return L.normalized_best(L.OneVsRest(rounds=20).fit(grams, labels).scores(grams))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_outer_join(spark, d):
    return R.with_default(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS attrs FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def pivot_last_tag(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.col("event_id").cast("string").alias("value"), "event_id")
    pivoted = R.pivot_map(e, "user_id", "event_type", "value", "event_id")
    return pivoted.select("user_id", F.expr("array_join(transform(map_entries(attrs), x -> concat(x.key, '=', x.value)), ',')").alias("attrs"))


@query("""
WITH e AS (SELECT DISTINCT s_nationkey::BIGINT AS src, (s_suppkey % 25)::BIGINT AS dst, CASE WHEN s_suppkey % 4 = 0 THEN 'N-Gram' ELSE 'Match' END AS label FROM supplier)
SELECT dst, bool_and(label = 'Match') AS consequent FROM e GROUP BY dst""")
def consequent_flags(spark, d):
    e = t(spark, d, "supplier").selectExpr("0 as sample_id", "bigint(s_nationkey) as src", "bigint(s_suppkey % 25) as dst", "case when s_suppkey % 4 = 0 then 'N-Gram' else 'Match' end as label").distinct()
    return G.all_inferred(e, ["Match"]).select("dst", "consequent")


@query(f"""WITH RECURSIVE {_STEPS_SQL}, r(source, node) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT source, dst FROM r JOIN e ON node = src WHERE label NOT IN ('BUILDING', 'shortcut')) SELECT source, node FROM r""")
def reachable_nodes(spark, d):
    """Without two kinds of edges, as is the operator's use."""
    return G.reachable(_steps(spark, d), t(spark, d, "nation").selectExpr("bigint(n_nationkey) as source"), ["BUILDING", "shortcut"])


@query("""
WITH RECURSIVE c(term_id, ancestor) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey >= 1 UNION SELECT term_id, ancestor // 2 FROM c WHERE ancestor > 1)
SELECT DISTINCT term_id, 'L:' || (ancestor % 10) AS linked_id FROM c WHERE ancestor % 7 = 0""")
def superterm_links(spark, d):
    p = t(spark, d, "part").where("p_partkey >= 1")
    links = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("term_id"), F.concat(F.lit("L:"), (F.col("p_partkey") % 10).cast("string")).alias("linked_id"))
    return R.superterm_links(G.closure_of_all(_halves(spark, d), p.select(F.col("p_partkey").alias("term_id"))), links)
