"""Record classification: n-gram and term features, mutual information, one-vs-rest L1 logistic regression, rules."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from termloom.functions import text as T
from termloom.functions.shared import staged


#: The classes' names as shown.
CLASS_NAMES = {
    "cell_line": "cell line",
    "stem_cells": "stem cells",
    "in_vitro_differentiated_cells": "in vitro differentiated cells",
    "primary_cells": "primary cells",
    "induced_pluripotent_stem_cells": "induced pluripotent stem cell line",
    "tissue": "tissue",
}


def class_name(c: Column) -> Column:
    """The shown name of a class; null stays null, an unknown class is an error."""
    names = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.try_element_at(names, c), F.raise_error(F.concat(F.lit("unknown class "), c))))


def classifier_grams(df: DataFrame, sample_id: str, col: str) -> DataFrame:
    """``(sample_id, gram)``: a row for each occurrence of a 1- or 2-gram in lower case, longer than one character.

    ``_``, ``/`` and ``-`` are blanks.
    """
    w = df.select(F.col(sample_id).alias("sample_id"), T.word_tokens(F.lower(F.translate(F.col(col), "_/-", "   "))).alias("_w"))
    grams = F.expr("concat(_w, case when size(_w) >= 2 then transform(sequence(1, size(_w) - 1), i -> concat(_w[i - 1], ' ', _w[i])) else array() end)")
    return w.select("sample_id", F.explode(grams).alias("gram")).where("length(gram) > 1")


def vocabulary(grams: DataFrame, above: int = 2, stop_words: DataFrame | None = None) -> DataFrame:
    """``(gram, tf, df)`` of grams in more than ``above`` samples and not among ``stop_words (gram)``."""
    out = grams.groupBy("sample_id", "gram").count().groupBy("gram").agg(F.sum("count").cast("long").alias("tf"), F.count("*").alias("df")).where(F.col("df") > above)
    return out.join(stop_words, "gram", "left_anti") if stop_words is not None else out


def mutual_information(presence: DataFrame, labels: DataFrame, above: int = 0) -> DataFrame:
    """``(gram, label, mi)`` in nats of a binary feature, one in more than ``above`` labelled samples, and a class against the rest.

    ``presence (sample_id, gram)`` distinct, ``labels (sample_id, label)``. From the counts of the feature, the class
    and both, so rows are read once and no contingency table is spread out.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("nl")).limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("more than 1000 classes")  # each feature gets a row for each class
    n = sum(r["nl"] for r in sizes)
    classes = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["nl"]).alias("nl")) for r in sizes])
    met = presence.join(labels, "sample_id")
    both = staged(met.groupBy("gram", "label").agg(F.count("*").alias("nb")), "feature-counts")
    by_gram = both.groupBy("gram").agg(F.sum("nb").alias("ng")).where(F.col("ng") > above)
    grid = by_gram.select("gram", "ng", F.inline(classes)).join(both, ["gram", "label"], "left").fillna(0, ["nb"]) if sizes else by_gram.withColumns({"label": F.lit(""), "nl": F.lit(0), "nb": F.lit(0)})
    cell = lambda x, r, c: f"case when {x} > 0 then {x} / {n}D * ln({x} * {n}D / ({r} * {c})) else 0D end"
    mi = " + ".join((cell("nb", "ng", "nl"), cell("(ng - nb)", "ng", f"({n} - nl)"), cell("(nl - nb)", f"({n} - ng)", "nl"), cell(f"({n} - ng - nl + nb)", f"({n} - ng)", f"({n} - nl)")))
    return grid.select("gram", "label", F.expr(mi).alias("mi"))


def top_features(mi: DataFrame, most: int = 75) -> DataFrame:
    """The ``most`` features of each class by mutual information (the number is the feature of this report); ties by name, the later first."""
    w = Window.partitionBy("label").orderBy(F.desc("mi"), F.desc("gram"))
    return mi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: The classes that a cell line's kind (a subset of its vocabulary) allows.
KIND_CLASSES = {
    "Induced_pluripotent_stem_cell": ["in_vitro_differentiated_cells", "induced_pluripotent_stem_cells"],
    "Cancer_cell_line": ["cell_line"],
    "Transformed_cell_line": ["cell_line"],
    "Finite_cell_line": ["cell_line"],
    "Spontaneously_cell_line": ["cell_line"],
    "Embryonic_stem_cell": ["stem_cells", "in_vitro_differentiated_cells"],
    "Telomerase_cell_line": ["cell_line"],
    "Conditionally_cell_line": ["cell_line"],
    "Hybridoma": ["cell_line"],
}
#: The terms and the property that the rules ask for.
XENOGRAFT, STEM_CELL, SPECIFIC_CELL, PRIMARY_CELL = "EFO:0003942", "CL:0000034", "CL:0002371", "CL:0000001"
PASSAGE, PASSAGE_UNIT = "EFO:0007061", "UO:0000189"
FLAGS = ("xenograft", "stem", "specific", "primary", "passaged", "divided")


def rule_facts(terms: DataFrame, values: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row of flags for each sample with a term or value that a rule asks for, and ``possible``: the classes its cell lines allow.

    ``terms (sample_id, term_id)``, ``values (sample_id, property_id, value, unit_id)``, ``kinds (term_id, subset)`` of
    cell lines. ``possible`` is null without a known kind; several kinds leave what all of them allow. ``divided``: a
    passage number above zero.
    """
    has = lambda t: (F.col("term_id") == t)
    no = F.lit(False)
    of_terms = terms.where(F.col("term_id").isin(XENOGRAFT, STEM_CELL, SPECIFIC_CELL, PRIMARY_CELL)).select(
        "sample_id", has(XENOGRAFT).alias("xenograft"), has(STEM_CELL).alias("stem"), has(SPECIFIC_CELL).alias("specific"), has(PRIMARY_CELL).alias("primary"), no.alias("passaged"), no.alias("divided"), F.lit(None).cast("string").alias("kind")
    )
    of_values = values.where((F.col("property_id") == PASSAGE) & (F.col("unit_id") == PASSAGE_UNIT)).select(
        "sample_id", *[no.alias(c) for c in FLAGS[:4]], F.lit(True).alias("passaged"), F.coalesce(F.col("value") > 0, no).alias("divided"), F.lit(None).cast("string").alias("kind")
    )
    known = kinds.where(F.col("subset").isin(*KIND_CLASSES)).select("term_id", F.col("subset").alias("kind")).distinct()
    of_kinds = terms.where(F.startswith("term_id", F.lit("CVCL:"))).join(known, "term_id").select("sample_id", *[no.alias(c) for c in FLAGS], "kind")
    allowed = F.create_map(*[x for k, v in KIND_CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = F.array(*map(F.lit, CLASS_NAMES))
    found = of_terms.unionByName(of_values).unionByName(of_kinds).groupBy("sample_id").agg(*[F.bool_or(c).alias(c) for c in FLAGS], F.collect_set("kind").alias("_k"))  # nine kinds at most
    possible = F.when(F.size("_k") > 0, F.aggregate("_k", every, lambda left, k: F.array_intersect(left, F.element_at(allowed, k))))
    return found.select("sample_id", *FLAGS, possible.alias("possible"))


def rule_scores(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Scores ``(sample_id, label, confidence)`` after the domain rules on :func:`rule_facts`; samples without facts keep theirs.

    A xenograft leaves only tissue and ends the rules. Passaging rules out tissue, and above zero passages primary
    cells. A cell line of known kind leaves the classes it allows. Without one, a stem cell rules out cell lines, tissue
    and primary cells, else a specific cell type tissue; a primary cell that isn't passaged rules out all but primary
    and stem cells.
    """
    c, lab = F.col("confidence"), F.col("label")
    yes = lambda flag: F.coalesce(flag, F.lit(False))
    unknown = F.col("possible").isNull()
    out = F.when(
        yes("xenograft"),
        lab != "tissue",
    ).otherwise(
        (yes("passaged") & (lab == "tissue"))
        | (yes("divided") & (lab == "primary_cells"))
        | yes(~F.array_contains("possible", lab))
        | (unknown & yes("stem") & lab.isin("cell_line", "tissue", "primary_cells"))
        | (unknown & ~yes("stem") & yes("specific") & (lab == "tissue"))
        | (unknown & yes("primary") & ~yes("passaged") & lab.isin("tissue", "cell_line", "induced_pluripotent_stem_cells", "in_vitro_differentiated_cells"))
    )
    return scores.join(facts, "sample_id", "left").select("sample_id", "label", F.when(out, 0.0).otherwise(c).alias("confidence"))


def normalized_best(scores: DataFrame) -> DataFrame:
    """``(sample_id, label, confidence)``: shares of the sum (zeros if it is zero) and the class of the largest, ties by name."""
    total = F.sum("confidence").over(Window.partitionBy("sample_id"))
    share = scores.withColumn("confidence", F.when(total > 0, F.col("confidence") / total).otherwise(0.0))
    w = Window.partitionBy("sample_id").orderBy(F.desc("confidence"), "label")
    return share.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


TERM_MARK = "\x01"


def features(grams: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``(sample_id, gram)`` of words with repeats and of terms once each; a term's name starts with a character no word has."""
    out = grams.select("sample_id", "gram")
    if terms is None:
        return out
    return out.unionByName(terms.select("sample_id", F.concat(F.lit(TERM_MARK), "term_id").alias("gram")).distinct())


def feature_counts(grams: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(sample_id, gram, n)``: what is not zero of each sample's vector over the features ``chosen (gram)``: words by count, terms by presence."""
    n = F.when(F.startswith("gram", F.lit(TERM_MARK)), F.lit(1)).otherwise(F.count("*")).cast("long")
    return grams.join(chosen.select("gram").distinct(), "gram", "left_semi").groupBy("sample_id", "gram").agg(n.alias("n"))


class OneVsRest:
    """A binary L1 logistic regression for each class over the same selected features."""

    def __init__(self, features: int = 75, above: int = 2, rounds: int = 60):
        self.features, self.above, self.rounds = features, above, rounds
        self.names: list[str] = []
        self.models: dict[str, LogisticRegressionModel] = {}

    def fit(self, grams: DataFrame, labels: DataFrame, stop_words: DataFrame | None = None) -> "OneVsRest":
        """``grams (sample_id, gram)`` as :func:`features` gives them; ``labels (sample_id, label)``; ``stop_words (gram)``."""
        own = grams.join(labels.select("sample_id").distinct(), "sample_id", "left_semi")
        counts = staged(own.groupBy("sample_id", "gram").agg(F.count("*").cast("int").alias("n")), "training-counts")  # texts are read once
        frequent = counts.groupBy("gram").count().where(F.col("count") > self.above).select("gram")
        vocab = frequent.join(stop_words, "gram", "left_anti") if stop_words is not None else frequent
        chosen = top_features(mutual_information(counts.join(vocab, "gram", "left_semi"), labels), self.features)
        self.names = sorted({r["gram"] for r in chosen.select("gram").distinct().collect()})  # classes x features at most
        data = staged(self._vectors(counts.select("sample_id", "gram", "n")).join(labels, "sample_id"), "training")
        n = max(data.count(), 1)
        self.models = {}
        for label in sorted(r["label"] for r in labels.select("label").distinct().collect()):
            lr = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / n, standardization=False, maxIter=self.rounds, featuresCol="features", labelCol="y")
            self.models[label] = lr.fit(data.withColumn("y", (F.col("label") == label).cast("double")))
        return self

    def _vectors(self, grams: DataFrame) -> DataFrame:
        """A vector for each sample with a gram, all zeros where it has no feature; other grams aren't gathered.

        ``grams (sample_id, gram)`` with a row for each occurrence, or with their number ``n``.
        """
        names = self.names or ["\x00"]
        model = CountVectorizerModel.from_vocabulary(names, "grams", "features")
        known = F.col("gram").isin(*names)
        each = F.array_repeat("gram", F.col("n")) if "n" in grams.columns else F.array("gram")
        lists = grams.groupBy("sample_id").agg(F.flatten(F.collect_list(F.when(known, each))).alias("grams"))
        return model.transform(lists).select("sample_id", "features")

    def scores(self, grams: DataFrame) -> DataFrame:
        """``(sample_id, label, confidence)``: each class's own probability. Vectors are made once for all classes."""
        v = self._vectors(grams)
        pairs = []
        for i, (label, model) in enumerate(self.models.items()):
            m = model.copy().setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
            v = m.transform(v)
            pairs.append(F.struct(F.lit(label).alias("label"), vector_to_array(f"_p{i}")[1].alias("confidence")))
        return v.select("sample_id", F.inline(F.array(*pairs)))

    def save(self, path: str) -> None:
        """The features and the classes' models under ``path``, in place of any there."""
        spark = SparkSession.getActiveSession()
        for i, model in enumerate(self.models.values()):
            model.write().overwrite().save(f"{path}/model-{i}")
        head = {"names": self.names, "labels": list(self.models), "features": self.features, "above": self.above, "rounds": self.rounds}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OneVsRest":
        head = json.loads(spark.read.text(f"{path}/head").first()["value"])
        out = cls(head["features"], head["above"], head["rounds"])
        out.names = head["names"]
        out.models = {label: LogisticRegressionModel.load(f"{path}/model-{i}") for i, label in enumerate(head["labels"])}
        return out
