"""Token generators over ``token (sample_id, tok, start, end, kv_key, kv_value, side)``.

Tokens carry the key-value pair and side that they stem from, so what is downstream of a pair is a filter. Intervals
are in characters, half open, within the pair's own run of offsets. A further column ``path`` goes with each token to
what is made of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from termloom.functions import text as T

LINEAGE = ("sample_id", "kv_key", "kv_value", "side")


def _carried(tokens: DataFrame) -> list[str]:
    return [c for c in tokens.columns if c == "path"]


def kv_pairs(df: DataFrame, sample_id: str, columns: list[str]) -> DataFrame:
    """Named columns of wide rows as ``kv (sample_id, kv_key, kv_value)``; nulls are left out."""
    return df.select(F.col(sample_id).alias("sample_id"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("kv_key", "kv_value")).where("kv_value is not null")


def block_pairs(kv: DataFrame, keys: list[str] = (), values: list[str] = ()) -> DataFrame:
    """Pairs whose key and value are on neither list; exact and case-sensitive."""
    return kv.where(~F.col("kv_key").isin(*keys) if keys else F.lit(True)).where(~F.col("kv_value").isin(*values) if values else F.lit(True))


def init_tokens(kv: DataFrame) -> DataFrame:
    """Each key and each value as a token; offsets run through a sample's pairs in the order of (key, value)."""
    size = F.length("kv_key") + F.length("kv_value")
    w = Window.partitionBy("sample_id").orderBy("kv_key", "kv_value").rowsBetween(Window.unboundedPreceding, -1)
    at = kv.withColumn("_at", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int"))
    mid = (F.col("_at") + F.length("kv_key")).alias("e")
    sides = F.array(
        F.struct(F.col("kv_key").alias("tok"), F.col("_at").alias("start"), mid.cast("int").alias("end"), F.lit("key").alias("side")),
        F.struct(F.col("kv_value").alias("tok"), mid.cast("int").alias("start"), (F.col("_at") + size).cast("int").alias("end"), F.lit("val").alias("side")),
    )
    return at.select("sample_id", "kv_key", "kv_value", F.inline(sides)).select("sample_id", "tok", "start", "end", "kv_key", "kv_value", "side")


def ngrams(tokens: DataFrame, most: int = 8) -> DataFrame:
    """Runs of 1 to min(most, words) - 1 words, so never the whole token; offsets are of the words joined by one blank."""
    t = tokens.withColumn("_w", T.word_tokens(F.col("tok"))).where("size(_w) > 1")
    t = t.withColumn("_e", F.expr("transform(_w, (w, i) -> aggregate(slice(_w, 1, i + 1), -1, (a, x) -> a + length(x) + 1))"))
    runs = F.expr(
        f"flatten(transform(sequence(1, least({most}, size(_w)) - 1), n -> transform(sequence(1, size(_w) - n + 1), i -> struct("
        "array_join(slice(_w, i, n), ' ') as gram, start + _e[i - 1] - length(_w[i - 1]) as s, start + _e[i + n - 2] as e))))"
    )
    return t.select(*LINEAGE, *_carried(tokens), F.inline(runs)).select("sample_id", F.col("gram").alias("tok"), F.col("s").alias("start"), F.col("e").alias("end"), "kv_key", "kv_value", "side", *_carried(tokens)).distinct()


def lowercase(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("tok", F.lower("tok"))


def delimit(tokens: DataFrame, delimiter: str) -> DataFrame:
    """The pieces between literal delimiters, empty ones too, of tokens that hold one."""
    quoted = delimiter.replace("\\", "\\\\")
    t = tokens.where(F.contains("tok", F.lit(delimiter))).withColumn("_p", F.split("tok", f"\\Q{quoted}\\E", -1))
    pieces = F.expr(f"transform(_p, (p, i) -> struct(p as piece, int(start + aggregate(slice(_p, 1, i), 0, (a, x) -> a + length(x) + {len(delimiter)})) as s))")
    out = t.select(*LINEAGE, *_carried(tokens), F.inline(pieces)).withColumns({"tok": F.col("piece"), "start": F.col("s"), "end": (F.col("s") + F.length("piece")).cast("int")})
    return out.select("sample_id", "tok", "start", "end", "kv_key", "kv_value", "side", *_carried(tokens)).distinct()


def expand_sets(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """For tokens in a set ``(set_id, member)``, the other members, at the token's interval."""
    mate = sets.select("set_id", F.col("member").alias("mate"))
    pairs = sets.join(mate, "set_id").where("member <> mate").select("member", "mate").distinct()
    return tokens.join(pairs, tokens["tok"] == pairs["member"]).drop("member").withColumn("tok", F.col("mate")).drop("mate")


def expand_map(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """For tokens equal to ``from_str``, each ``to_str`` of ``mapping`` (acronyms, and lists of one's own); case-sensitive."""
    return tokens.join(mapping, tokens["tok"] == mapping["from_str"]).withColumn("tok", F.col("to_str")).drop("from_str", "to_str")


def lexicon_variants(tokens: DataFrame, forms: DataFrame, variants: DataFrame, kinds: list[str]) -> DataFrame:
    """The token with its last word replaced by the base and the variants of every entry that has the word as a form.

    ``forms (form, eui)``, ``variants (eui, kind, variant)``. Only tokens that end with the word's letters are replaced.
    """
    t = tokens.withColumn("_last", T.alnum_core(F.element_at(T.words(F.col("tok")), -1))).where("_last <> '' and endswith(tok, _last)")
    v = variants.where(F.col("kind").isin("base", *kinds)).select("eui", "variant").distinct()
    met = t.join(forms, t["_last"] == forms["form"]).join(v, "eui").where("variant <> _last")
    return met.withColumn("tok", F.expr("concat(substring(tok, 1, length(tok) - length(_last)), variant)")).select(*tokens.columns).distinct()


def property_synonyms(tokens: DataFrame, key_terms: DataFrame, sets: DataFrame) -> DataFrame:
    """Value tokens of pairs whose key reaches property P, expanded by P's own sets ``(property_id, set_id, member)``.

    ``key_terms (sample_id, kv_key, kv_value, term_id)``: the terms that each pair's key reaches.
    """
    values = tokens.where("side = 'val'").join(key_terms, ["sample_id", "kv_key", "kv_value"])
    mate = sets.select("property_id", "set_id", F.col("member").alias("mate"))
    met = values.join(sets, (values["term_id"] == sets["property_id"]) & (values["tok"] == sets["member"])).drop("member").join(mate, ["property_id", "set_id"])
    return met.where("mate <> tok").withColumn("tok", F.col("mate")).select(*tokens.columns).distinct()


def time_tokens(tokens: DataFrame) -> DataFrame:
    """The number, the unit and the unit written out of tokens like ``48h``, as tokens of the same interval."""
    t = tokens.withColumn("_t", T.time_and_unit(F.col("tok"))).where("_t is not null")
    parts = F.filter(F.array("_t.number", "_t.unit", "_t.expanded"), lambda x: x.isNotNull())
    return t.withColumn("tok", F.explode(parts)).select(*tokens.columns).distinct()
