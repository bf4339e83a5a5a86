import itertools

import pytest

from termloom.operators import learning as L

CLASSES = list(L.CLASS_NAMES)


def ruled(terms, values, kinds):
    """The rules said plainly, for one sample: the set of classes left."""
    left = set(CLASSES)
    if L.XENOGRAFT in terms:
        return left & {"tissue"}
    passed = [v for p, v, u in values if (p, u) == (L.PASSAGE, L.PASSAGE_UNIT)]
    if passed:
        left -= {"tissue"}
    if any(v > 0 for v in passed):
        left -= {"primary_cells"}
    known = [k for t in terms for k in kinds.get(t, ()) if k in L.KIND_CLASSES]
    for k in known:
        left &= set(L.KIND_CLASSES[k])
    if not known:
        if L.STEM_CELL in terms:
            left -= {"cell_line", "tissue", "primary_cells"}
        elif L.SPECIFIC_CELL in terms:
            left -= {"tissue"}
        if L.PRIMARY_CELL in terms and not passed:
            left -= {"tissue", "cell_line", "induced_pluripotent_stem_cells", "in_vitro_differentiated_cells"}
    return left


def test_rules_on_all_combinations(spark):
    kinds = {"CVCL:1": ["Hybridoma"], "CVCL:2": ["Embryonic_stem_cell", "Human"], "CVCL:3": ["Human"], "CVCL:4": ["Induced_pluripotent_stem_cell"]}
    some_terms = [L.XENOGRAFT, L.STEM_CELL, L.SPECIFIC_CELL, L.PRIMARY_CELL, *kinds]
    some_values = [[], [(L.PASSAGE, 0.0, L.PASSAGE_UNIT)], [(L.PASSAGE, 3.0, L.PASSAGE_UNIT)], [(L.PASSAGE, 3.0, "missing"), ("EFO:0000246", 3.0, L.PASSAGE_UNIT)]]
    cases = [(c, v) for n in range(4) for c in itertools.combinations(some_terms, n) for v in some_values]
    terms = spark.createDataFrame([(i, t) for i, (c, _) in enumerate(cases) for t in c], "sample_id int, term_id string")
    values = spark.createDataFrame([(i, *v) for i, (_, vs) in enumerate(cases) for v in vs], "sample_id int, property_id string, value double, unit_id string")
    table = spark.createDataFrame([(t, k) for t, ks in kinds.items() for k in ks], "term_id string, subset string")
    scores = spark.createDataFrame([(i, c, 0.5) for i in range(len(cases)) for c in CLASSES], "sample_id int, label string, confidence double")
    got = {}
    for r in L.rule_scores(scores, L.rule_facts(terms, values, table)).collect():
        got.setdefault(r.sample_id, set())
        if r.confidence > 0:
            got[r.sample_id].add(r.label)
    assert len(got) == len(cases)
    for i, (c, v) in enumerate(cases):
        assert got[i] == ruled(c, v, kinds), (c, v)


@pytest.fixture(scope="module")
def annotated(spark):
    """Thirty samples of three classes; the word tells two of them apart, only a term the third."""
    rows = [(i, ("cell_line", "tissue", "stem_cells")[i % 3]) for i in range(30)]
    word = {"cell_line": "cultured", "tissue": "biopsy", "stem_cells": "biopsy"}
    grams = spark.createDataFrame([(i, w) for i, c in rows for w in (word[c], "the", f"only{i}")], "sample_id int, gram string")
    terms = spark.createDataFrame([(i, L.STEM_CELL) for i, c in rows if c == "stem_cells"] * 2, "sample_id int, term_id string")
    return L.features(grams, terms), spark.createDataFrame(rows, "sample_id int, label string")


def test_learns_words_and_terms_and_is_kept(spark, annotated, tmp_path):
    both, labels = annotated
    model = L.OneVsRest(features=5).fit(both, labels, spark.createDataFrame([("the",)], "gram string"))
    assert set(model.names) == {"cultured", "biopsy", L.TERM_MARK + L.STEM_CELL}
    want = {(r.sample_id, r.label) for r in labels.collect()}
    asked = both.unionByName(spark.createDataFrame([(99, None)], both.schema))
    rows = L.normalized_best(model.scores(asked)).collect()
    assert {(r.sample_id, r.label) for r in rows if r.sample_id != 99} == want
    assert len(rows) == 31  # a sample without a word is scored too
    model.save(str(tmp_path / "m"))
    again = L.OneVsRest.load(spark, str(tmp_path / "m"))
    key = lambda r: (r.sample_id, r.label)
    a, b = (sorted(m.scores(both).collect(), key=key) for m in (model, again))
    assert a == b


def test_regressions_end_where_the_penalised_likelihood_is_flat(spark):
    """Of each class: the gradient of the mean loss is within the penalty where a weight is zero, and equal to it elsewhere."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(240):
        label = "abc"[i % 3]
        words = [label * 2] * int(rng.integers(0, 3)) + [w for w in ("xx", "yy", "zz") if rng.random() < 0.5]
        rows += [(i, w) for w in words]
        labels.append((i, label))
    grams, lab = spark.createDataFrame(rows, "sample_id long, gram string"), spark.createDataFrame(labels, "sample_id long, label string")
    model = L.OneVsRest(features=5, rounds=300).fit(grams, lab)
    data = {r.sample_id: r.features.toArray() for r in model._vectors(grams).collect()}
    x = np.array([data[i] for i in sorted(data)])
    n = len(x)
    for label, m in model.models.items():
        y = np.array([dict(labels)[i] == label for i in sorted(data)], float)
        p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
        g, w = x.T @ (p - y) / n, m.coefficients.toArray()
        assert abs((p - y).mean()) < 1e-3 and (np.abs(g) <= 1 / n + 1e-3).all()
        assert np.allclose(g[np.abs(w) > 1e-6], -np.sign(w[np.abs(w) > 1e-6]) / n, atol=1e-3) and (np.abs(w) > 1e-6).any()
    got = {(r.sample_id, r.label): r.confidence for r in model.scores(grams).collect()}
    for k, (label, m) in enumerate(model.models.items()):
        p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
        assert all(abs(got[i, label] - p[at]) < 1e-9 for at, i in enumerate(sorted(data)))
