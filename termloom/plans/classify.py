"""The classes of samples: training from an annotated set, prediction with the domain rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termloom.operators import learning as L, relational as R


def sample_features(kv: DataFrame, terms: DataFrame, samples: DataFrame) -> DataFrame:
    """``(sample_id, gram)`` of ``samples (sample_id)``: words of keys and values with repeats, terms once, and one null for each sample, so that none is missing."""
    both = L.classifier_grams(kv, "sample_id", "kv_key").unionByName(L.classifier_grams(kv, "sample_id", "kv_value"))
    known = samples.select("sample_id").distinct()
    every = L.features(both, terms).join(known, "sample_id", "left_semi")
    return every.unionByName(known.withColumn("gram", F.lit(None).cast("string")))


def training_samples(labels: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """``labels (sample_id, label)`` without 'other', and with ``studies (study, sample_id)`` only the first sample of each."""
    kept = labels.where("label <> 'other'")
    if studies is None:
        return kept
    first = R.first_per_group(studies, "study", "sample_id", F.lit(False)).select("sample_id").distinct()
    return kept.join(first, "sample_id", "left_semi")


def train(kv: DataFrame, terms: DataFrame, labels: DataFrame, stop_words: DataFrame | None = None, **options) -> L.OneVsRest:
    """``terms (sample_id, term_id)`` with ancestors."""
    grams = sample_features(kv, terms, labels)
    return L.OneVsRest(**options).fit(grams.where("gram is not null"), labels, stop_words)


def predict(model: L.OneVsRest, kv: DataFrame, terms: DataFrame, values: DataFrame, kinds: DataFrame, samples: DataFrame) -> DataFrame:
    """``(sample_id, sample_type, confidence)`` of all ``samples``: shares after the rules, the largest, ties by class."""
    scores = model.scores(sample_features(kv, terms, samples))
    best = L.normalized_best(L.rule_scores(scores, L.rule_facts(terms, values, kinds)))
    return best.select("sample_id", F.col("label").alias("sample_type"), "confidence")


def unmapped(kv: DataFrame, samples: DataFrame) -> DataFrame:
    """``(n_samples, n_unmapped)``: samples of ``kv`` and those of them that aren't among the mapped ``samples``; these aren't predicted."""
    s = kv.select("sample_id").distinct().join(samples.select("sample_id").distinct().withColumn("_m", F.lit(True)), "sample_id", "left")
    return s.agg(F.count("*").alias("n_samples"), F.count_if(F.col("_m").isNull()).alias("n_unmapped"))
