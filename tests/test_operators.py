import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.components import connected_components
from termloom.operators import graph as G, learning as L, matching as M, relational as R, rules as U, tokens as K
from termloom.plans import annotate as A
from termloom.plans.annotate import Rules, Vocabulary, annotate
from termloom.sources import readers


def one(spark, c, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(c.alias("x")).first()["x"]


def test_numbers(spark):
    for s in ("1", "1.5", "-2", ".5", "5.", "1e5", "1_000", " 12 ", "12d", "5f", "1__0", "", "abc", "0x1", "--1", "1e", "7_", "nan", "-inf"):
        try:
            want = float(s)
        except ValueError:
            want = None
        got = one(spark, T.to_number(F.col("s")), s=s)
        assert got == want or (want != want and got != got), s


def test_text(spark):
    assert one(spark, T.char_counts_distance(F.col("a"), F.col("b")), a="aaab", b="aabcc") == 2
    assert one(spark, T.library_layout(F.col("a")), a="PAIRED - NOMINAL_LENGTH: 101; |132") == "PAIRED"
    assert one(spark, T.uncapitalize(F.col("a")), a="Breast  Cancer DNA A") == "breast cancer DNA A"
    assert tuple(one(spark, T.time_and_unit(F.col("a")), a="48h")) == ("48", "h", "hour")
    assert one(spark, T.time_and_unit(F.col("a")), a="48hrs") is None


def _kv(spark, *rows):
    return spark.createDataFrame(list(rows), "sample_id string, kv_key string, kv_value string")


def test_ngrams_and_delimiters(spark):
    tok = K.init_tokens(_kv(spark, ("a", "k", "vastus lateralis muscle_female"))).where("side = 'val'")
    got = {(r.tok, r.start, r.end) for r in K.ngrams(tok).collect()}
    assert got == {("vastus", 1, 7), ("lateralis", 8, 17), ("muscle_female", 18, 31), ("vastus lateralis", 1, 17), ("lateralis muscle_female", 8, 31)}
    assert {(r.tok, r.start, r.end) for r in K.delimit(tok, "_").collect()} == {("vastus lateralis muscle", 1, 24), ("female", 25, 31)}
    plus = K.init_tokens(_kv(spark, ("a", "k", "CD4+"))).where("side = 'val'")
    assert {r.tok for r in K.delimit(plus, "+").collect()} == {"CD4", ""}


def test_attribute_text(spark):
    df = spark.createDataFrame([("s", "a: 1 || b: x:y || junk || a: 2")], "id string, raw string")
    assert {(r.tag, r.value) for r in R.tagged_pairs(df, "id", F.col("raw")).collect()} == {("a", "2"), ("b", "x")}


@pytest.mark.parametrize("common", [200, 0, 3])
def test_fuzzy_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(M, "COMMON", common)
    rng = random.Random(5)
    base = ["serial name no. " + str(1000 + i) for i in range(30)] + ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 32))) for _ in range(150)]

    def mutate(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]]) or "q"
        return s

    asked = sorted({mutate(s) for s in base for _ in range(3)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for q in asked:
        if len(q) < 4:
            continue
        hits = [(lev(q, s), s) for s in set(base)]
        hits = [(e, s) for e, s in hits if e <= 2 and e / max(len(q), len(s)) <= 0.1]
        want |= {(q, s, e) for e, s in hits if e == min(h[0] for h in hits)}
    got = {tuple(r) for r in M.fuzzy_match(spark.createDataFrame([(q,) for q in asked], "tok string"), spark.createDataFrame([(s,) for s in base], "s string")).collect()}
    assert got == want and len(want) > 20


def test_fuzzy_of_one_beginning(spark):
    """20,000 strings with one beginning: what is compared grows with the near pairs."""
    s = spark.range(20_000).select(F.concat(F.lit("Supplier "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("s"))
    asked = s.select(F.concat(F.lit("supplier"), F.substring("s", F.lit(9), F.length("s"))).alias("tok"))
    got = M.fuzzy_match(asked, s)
    assert got.count() == 20_000 and got.where("edit_dist <> 1 or lower(tok) <> lower(s)").count() == 0


def test_contained_as_brute_force(spark):
    rng = random.Random(11)
    spans = {(rng.choice("ab"), x, x + rng.choice((0, 1, 2, 3, 5, 9, 30, 64, 200)), rng.choice(["t1", "t2", "t3", "t4"])) for x in (rng.randrange(150) for _ in range(250))}
    up = {("t1", "t1"), ("t2", "t2"), ("t3", "t3"), ("t4", "t4"), ("t1", "t2"), ("t3", "t2"), ("t1", "t4")}

    def keeps(m):
        around = {(b[1], b[2]) for b in spans if b[0] == m[0] and b[1] <= m[1] and b[2] >= m[2] and (b[1], b[2]) != (m[1], m[2])}
        return all(any(b[0] == m[0] and (b[1], b[2]) == i and (b[3], m[3]) in up for b in spans) for i in around)

    df = spark.createDataFrame(sorted(spans), "sample_id string, start int, end int, term_id string")
    got = {tuple(r) for r in U.drop_contained(df, spark.createDataFrame(sorted(up), "term_id string, ancestor string")).collect()}
    assert got == {m for m in spans if keeps(m)} and 0 < len(got) < len(spans)
    bare = {tuple(r) for r in U.drop_contained(df).collect()}
    assert bare == {m for m in spans if not any(b[0] == m[0] and b[1] <= m[1] and b[2] >= m[2] and (b[1], b[2]) != (m[1], m[2]) for b in spans)}


def test_words_as_treebanks_part_them(spark):
    for text, want in (
        ("They'll save and invest more.", "They 'll save and invest more ."), ("hi, my name can't hello,", "hi , my name ca n't hello ,"), ("blood (whole), 48h", "blood ( whole ) , 48h"),
        ('He said "it\'s 1,000: yes"--then left...', 'He said " it \'s 1,000 : yes " -- then left ...'), ("cannot gonna O'Neil's dogs'", "can not gon na O'Neil 's dogs '"),
        ("a:b 3:4 50% R&D `` x ''", 'a : b 3:4 50 % R & D " x "'), ("A. B. C.)", "A. B. C . )"), ("", ""),
    ):
        assert " ".join(one(spark, T.word_tokens(F.col("a")), a=text)) == want


def test_graph_nodes_edges_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "x")], "src string, dst string")
    paths = {(r.source, r.node): r.path for r in G.shortest_paths(e, spark.createDataFrame([("a",), ("x",)], "source string")).collect()}
    assert paths == {("a", "a"): ["a"], ("a", "b"): ["a", "b"], ("a", "c"): ["a", "c"], ("a", "d"): ["a", "b", "d"], ("x", "x"): ["x"]}
    back = {r.node: r.path for r in G.shortest_paths(e, spark.createDataFrame([("d",)], "source string"), reverse=True).collect()}
    assert back["a"] == ["d", "b", "a"]
    with pytest.raises(RuntimeError, match="more than 1 edges"):
        G.shortest_paths(e, spark.createDataFrame([("a",)], "source string"), rounds=1)
    with pytest.raises(RuntimeError, match="peeled"):
        G.on_cycles(spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int"), rounds=2)
    left = G.delete_edges(e, spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert {tuple(r) for r in left.collect()} == {("b", "d"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "x")}
    n = spark.createDataFrame([("z",)], "node string")
    assert {r.node for r in G.all_nodes(n, e).collect()} == set("abcdxz")
    assert {tuple(r) for r in G.children(e, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", "b"), ("a", "c")}
    assert {r.node for r in G.targets(e, spark.createDataFrame([("d",), ("z",)], "node string")).collect()} == {"d"}


def test_closure_by_doubling(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 200)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(20)] + [(300 + i, 301 + i) for i in range(40)], "child int, parent int")
    nodes = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "term_id int")
    assert {tuple(r) for r in G.closure_of_all(edges, nodes).collect()} == {tuple(r) for r in G.closure(edges, nodes).collect()}
    with pytest.raises(RuntimeError, match="chains"):
        G.closure_of_all(edges, nodes, rounds=2)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "term_id string")
    c = G.closure(e, nodes)
    assert c.count() == 13
    assert G.on_cycles(e.toDF("src", "dst")).count() == 3 + 1
    up = G.closure(spark.createDataFrame([("child", "parent")], "child string, parent string"), spark.createDataFrame([("child",), ("parent",), ("x",)], "term_id string"))
    m = spark.createDataFrame([("s", "child"), ("s", "parent"), ("s", "x")], "set_id string, term_id string")
    assert {r.term_id for r in G.most_specific(m, up).collect()} == {"child", "x"}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 600)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules(spark):
    terms = spark.createDataFrame([("s", "CL:0000084")], "sample_id string, term_id string")
    arts = spark.createDataFrame([("s", "CD4+"), ("s", "naive")], "sample_id string, tok string")
    need_t = spark.createDataFrame([(r, "CL:0000084") for r in ("CL:0000624", "CL:0000625", "CL:0000898", "CL:0000895")], "rule string, term_id string")
    need_a = spark.createDataFrame(
        [("CL:0000624", 0, "CD4+"), ("CL:0000625", 0, "CD8+"), ("CL:0000898", 0, "naive"), ("CL:0000895", 0, "CD4+"), ("CL:0000895", 0, "CD4-positive"), ("CL:0000895", 1, "naive")], "rule string, set_no int, tok string"
    )
    assert {r.rule for r in U.combinations(terms, arts, need_t, need_a).collect()} == {"CL:0000624", "CL:0000898", "CL:0000895"}


OBO = """format-version: 1.2

[Term]
id: DOID:1
name: disease

[Term]
id: DOID:2
name: breast cancer
def: "A \\"bad\\" one." [x]
synonym: "mammary carcinoma" EXACT []
synonym: "breast thing" RELATED []
is_a: DOID:1 ! disease
is_a: XX:9 ! foreign
relationship: part_of UB:3 ! part
subset: slim

[Term]
id: DOID:3
name: old
is_obsolete: true

[Term]
id: EFO:0000246
name: age

[Term]
id: UO:0000036
name: year

[Typedef]
id: part_of
name: part of
"""


@pytest.fixture(scope="module")
def obo(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("obo") / "x.obo"
    path.write_text(OBO)
    return readers.read_obo(spark, str(path), "X", ["DOID", "EFO", "UO"])


def test_obo(obo):
    assert {r.term_id for r in obo["term"].collect()} == {"DOID:1", "DOID:2", "EFO:0000246", "UO:0000036"}
    assert {(r.syn, r.syn_type) for r in obo["synonym"].collect()} == {("mammary carcinoma", "EXACT"), ("breast thing", "RELATED")}
    assert {(r.child, r.rel, r.parent) for r in obo["rel"].collect()} == {("DOID:2", "is_a", "DOID:1"), ("DOID:2", "part_of", "UB:3")}


def test_lexicon(spark, tmp_path):
    (tmp_path / "lex").write_text("{base=tumor\nentry=E1\n}\n{base=cell\nentry=E2\n}\n")
    (tmp_path / "spl").write_text("E1|tumour|x\nE9|none|x\n")
    (tmp_path / "agr").write_text("E2|cells|x\nE2|cell|x\n")
    lex = readers.read_lexicon(spark, str(tmp_path / "lex"))
    forms, variants = readers.assemble_lexicon(lex, readers.read_variants(spark, str(tmp_path / "spl"), "spelling", lex), readers.read_variants(spark, str(tmp_path / "agr"), "inflection", lex))
    tok = K.init_tokens(_kv(spark, ("a", "k", "big tumour"), ("a", "k", "stem cell"))).where("side = 'val'")
    assert {r.tok for r in K.lexicon_variants(tok, forms, variants, ["inflection", "spelling"]).collect()} == {"big tumor", "stem cells"}


def test_annotate(spark, obo):
    kv = _kv(spark, ("s1", "disease", "Mammary carcinoma"), ("s1", "age", "48 year"), ("s1", "project", "breast cancer"), ("s2", "note", "breast cancers"), ("s3", "note", "nothing"))
    vocab = Vocabulary(readers.dictionary(obo), obo["rel"].select("child", "parent"))
    mapped, values = annotate(spark, kv, vocab, Rules(filter_keys=["project"]))
    rows = {(r.sample_id, r.term_id): r for r in mapped.collect()}
    assert ("s1", "DOID:2") in rows and rows["s1", "DOID:2"].orig_key == "disease" and not rows["s1", "DOID:2"].consequent
    assert ("s2", "DOID:2") in rows and not any(k[0] == "s3" for k in rows)
    assert rows["s1", "EFO:0001272"].consequent
    assert {(r.property_id, r.value, r.unit_id) for r in values.collect()} == {("EFO:0000246", 48.0, "UO:0000036")}


def test_annotate_origins(spark):
    """Paths and origins, inferences of both kinds, and what follows from a match that gave way."""
    names = [("jurkat cell", "CVCL:1"), ("jurkat", "CVCL:2"), ("t cell", "CL:1"), ("source", "EFO:0000322"), ("tissue", "X:1"), ("kidney", "X:2")]
    dictionary = spark.createDataFrame([(s, t, "TERM_NAME") for s, t in names], "s string, term_id string, target string")
    rules = Rules(
        superterm_links=spark.createDataFrame([("CVCL:1", "L:1"), ("CVCL:2", "L:2"), ("X:2", "L:3")], "term_id string, linked_id string"),
        disease_links=spark.createDataFrame([("CVCL:1", "D:1"), ("X:2", "L:3")], "term_id string, implied_id string"),
        consequents={"X:2": ["K:1"], "L:3": ["K:2"]},
        combinations=(
            spark.createDataFrame([("r", "CL:1"), ("r", "X:2")], "rule string, term_id string"),
            spark.createDataFrame([("r", 0, "naive"), ("r", 0, "fresh")], "rule string, set_no int, tok string"),
            spark.createDataFrame([("r", "C:1")], "rule string, term_id string"),
        ),
        facts=(
            spark.createDataFrame([("CVCL:1", "F:1"), ("CVCL:2", "F:2")], "fact_id string, term_id string"),
            spark.createDataFrame([("CVCL:1", "EFO:0000246", 60.0, "UO:0000036"), ("CVCL:2", "EFO:0000246", 70.0, "UO:0000036")], "fact_id string, property_id string, value double, unit_id string"),
        ),
    )
    edges = spark.createDataFrame([], "child string, parent string")
    kv = _kv(spark, ("a", "source", "Jurkat cell"), ("b", "note", "naive t cell"), ("b", "organ", "kidney"), ("c", "organ", "jurkat cell"), ("d", "source", None), ("e", "organ", "kidney"), ("e", "organ", "kidney"))
    mapped, values = annotate(spark, kv, Vocabulary(dictionary, edges), rules)
    got = {(r.sample_id, r.term_id): r for r in mapped.collect()}
    of = lambda x: {t: r.consequent for (s, t), r in got.items() if s == x}
    adult = dict.fromkeys(("EFO:0001272", "UBERON:0007023", "CL:0000010", "EFO_BTO:0000214"), True)
    assert of("a") == {"CVCL:1": False, "EFO:0000322": False, "L:1": True, "D:1": False, "F:1": True} | adult  # nothing of CVCL:2, inside CVCL:1
    assert of("b") == {"CL:1": False, "X:2": False, "L:3": False, "K:1": True, "K:2": True, "C:1": False}
    assert of("e") == {"X:2": False, "L:3": False, "K:1": True, "K:2": True}
    assert of("c") == {}  # a cell line without a key that licenses it, and what would follow
    steps = [tuple(x) for x in got["a", "F:1"].path]
    assert steps == [("val", "Jurkat cell"), ("lower case", "jurkat cell"), ("TERM_NAME", "CVCL:1"), ("fact of a cell line", "F:1")]
    assert (got["a", "F:1"].hops, got["a", "F:1"].orig_key, got["a", "F:1"].orig_value) == (4, "source", "Jurkat cell")
    assert [x.step for x in got["b", "CL:1"].path] == ["val", "n-gram", "TERM_NAME"]
    assert {(r.sample_id, r.value, r.consequent) for r in values.collect()} == {("a", 60.0, True)}


def test_best_class(spark):
    s = spark.createDataFrame([("a", "tissue", 0.2), ("a", "cell_line", 0.8), ("b", "tissue", 0.0), ("b", "cell_line", 0.0)], "sample_id string, label string, confidence double")
    none = spark.createDataFrame([], "sample_id string, property_id string, value double, unit_id string")
    f = L.rule_facts(spark.createDataFrame([("a", L.XENOGRAFT)], "sample_id string, term_id string"), none, spark.createDataFrame([], "term_id string, subset string"))
    got = {(r.sample_id, r.label, r.confidence) for r in L.normalized_best(L.rule_scores(s, f)).collect()}
    assert got == {("a", "tissue", 1.0), ("b", "cell_line", 0.0)}


def test_override_resolve_and_first(spark):
    from termloom.operators import learning, relational

    a = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3"), ("y", "3")], "term_id string, linked_id string")
    b = spark.createDataFrame([("x", "9"), ("x", "9")], "term_id string, linked_id string")
    assert sorted(map(tuple, relational.override_links(a, b).collect())) == [("x", "9"), ("y", "3")]
    assert relational.override_links(a.limit(0), b.limit(0)).count() == 0
    names = spark.createDataFrame([("liver", "UBERON:1"), ("liver", "CL:2"), ("EFO:7", "EFO:8")], "term_name string, term_id string")
    asked = spark.createDataFrame([("liver",), ("CL:5",), ("EFO:7",), ("CL:5x",), (None,)], "asked string")
    assert sorted(map(tuple, relational.resolve_terms(names, asked).collect())) == [("CL:5", "CL:5"), ("EFO:7", "EFO:8"), ("liver", "CL:2"), ("liver", "UBERON:1")]
    rows = spark.createDataFrame([("s", 3, "TODO"), ("s", 4, None), ("s", 5, "ok"), ("z", 1, "TODO")], "study string, sample int, label string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in relational.first_per_group(rows, "study", "sample", F.col("label") == "TODO").collect()] == [("s", 4)]
    shown = spark.createDataFrame([("tissue",), (None,)], "c string").select(learning.class_name(F.col("c")))
    assert sorted(map(str, (r[0] for r in shown.collect()))) == ["None", "tissue"]


def test_written_tables_are_dropped(spark, monkeypatch):
    from termloom.functions import shared

    monkeypatch.setattr(shared, "_written", {})
    df = shared.staged(spark.range(5).toDF("x"), "dropped")
    (path,) = shared._written[spark.sparkContext.applicationId]
    assert df.count() == 5 and shared.drop_staged(spark) == 1 and shared.drop_staged(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def _linked(names, edges):
    """Pairs of links by plain sets, handed down to all terms below."""
    ok = [(s, t) for s, t, kind in names if s is not None and kind in ("TERM_NAME", "EXACT")]
    out = set()
    for b in {t for _, t, _ in names}:
        above, todo = {b}, [b]
        while todo:
            c = todo.pop()
            new = {p for x, p in edges if x == c} - above
            above, todo = above | new, todo + sorted(new)
        strings = {s for s, t in ok if t in above and t.startswith("B:")}
        out |= {(b, t) for s, t in ok if s in strings and t.startswith("A:")}
    return out


@pytest.mark.parametrize("members", [1000, 2])
def test_linked_tables_as_plain_sets(spark, monkeypatch, members):
    """Terms of several strings, null strings, other kinds, rows twice, terms of a below those of b, cycles."""
    monkeypatch.setattr(A, "MEMBERS", members)
    rng = random.Random(3)
    names = [(f"s{rng.randint(0, 12)}", f"{space}:{i}", rng.choice(["TERM_NAME", "EXACT", "RELATED"])) for space in "AB" for i in range(40) for _ in range(rng.randint(1, 3))]
    names += [(None, "A:1", "EXACT"), (None, "B:1", "EXACT"), ("only here", "C:1", "EXACT"), *names[:5]]
    edges = [(f"B:{i}", f"B:{rng.randint(0, i - 1)}") for i in range(1, 40) for _ in range(2)] + [("B:0", "B:17"), ("B:3", "B:3"), ("A:5", "B:20"), ("C:1", "B:2"), ("B:9", "X:1"), ("X:1", "B:4")]
    got = A.link_tables(spark.createDataFrame(names, "s string, term_id string, target string"), spark.createDataFrame(edges, "child string, parent string"), "A", "B")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) > 500
    assert set(rows) == _linked(names, edges)


def test_linked_pairs_are_never_shuffled(spark):
    """Pairs grow with the square of the terms of one string: the last step makes them, and nothing sorts or hashes them after."""
    names = spark.range(60).selectExpr("'one' as s", "concat(if(id % 2 = 0, 'A:', 'B:'), id) as term_id", "'EXACT' as target")
    got = A.link_tables(names, spark.createDataFrame([("B:3", "B:1")], "child string, parent string"), "A", "B")
    assert got.count() == 900
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top[0].startswith("Generate explode(linked") and not any("Aggregate" in line for line in top[: next(k for k, line in enumerate(top) if "Join" in line)])


def test_linked_pairs_take_few_bytes(spark, tmp_path):
    """Written as Parquet, whose dictionaries and runs hold: an eighth of a byte a pair, over half of one if the lists' ends fall between bytes."""
    names = spark.range(2003).selectExpr("'one' as s", "concat(if(id < 1003, 'A:', 'B:'), id) as term_id", "'EXACT' as target")
    A.link_tables(names, spark.createDataFrame([("B:1004", "B:1005")], "child string, parent string"), "A", "B").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1003 * 1000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.25 * 1003 * 1000


def test_marks_handed_down(spark):
    line = [(f"n{i}", f"n{i + 1}") for i in range(37)]
    edges = spark.createDataFrame([*line, ("n37", "n30"), ("x", "n5"), ("n2", "n2")], "child string, parent string")
    marks = spark.createDataFrame([("n37", "top"), ("n4", "low"), ("n4", "low"), ("alone", "top")], "term_id string, mark string")
    want = {(r.term_id, m) for r in G.closure(edges, spark.createDataFrame([(f"n{i}",) for i in range(38)] + [("x",), ("alone",)], "term_id string")).collect() for t, m in (("n37", "top"), ("n4", "low"), ("alone", "top")) if r.ancestor == t}
    got = [tuple(r) for r in G.handed_down(edges, marks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(RuntimeError, match="chains"):
        G.handed_down(edges, marks, rounds=2)
