"""Relational extract, merge, link and search operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termloom.functions import text as T


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one with the greatest ``order`` (ties: greatest other values); null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def tagged_pairs(df: DataFrame, key: str, raw: Column) -> DataFrame:
    """``(key, tag, value)`` of texts like ``a: 1 || b: 2``: the second piece is the value, the last of a tag's wins."""
    parts = df.select(F.col(key), F.posexplode(F.split(raw, r"\|\|")).alias("_p", "_t")).withColumn("_s", F.split("_t", ":"))
    rows = parts.where("size(_s) >= 2").select(key, "_p", F.trim(F.col("_s")[0]).alias("tag"), F.trim(F.col("_s")[1]).alias("value"))
    return rows.groupBy(key, "tag").agg(F.max_by("value", "_p").alias("value"))


def read_spec(df: DataFrame, key: str, raw: Column) -> DataFrame:
    """``(key, read_index, read_class, read_type, base_coord)`` of texts of ``||``-parted reads with ``;``-parted tags."""
    reads = df.select(F.col(key), F.posexplode(F.split(raw, r"\|\|")).alias("_r", "_t"))
    tags = reads.select(key, "_r", F.explode(F.split("_t", ";")).alias("_x")).withColumn("_s", F.split("_x", ":")).where("size(_s) >= 2")
    value = lambda name: F.max(F.when(F.trim(F.col("_s")[0]) == name, F.trim(F.col("_s")[1])))
    out = tags.groupBy(key, "_r").agg(
        value("READ_INDEX").try_cast("int").alias("read_index"), value("READ_CLASS").alias("read_class"), value("READ_TYPE").alias("read_type"), value("BASE_COORD").try_cast("int").alias("base_coord")
    )
    return out.drop("_r")


def union_sources(frames: dict[tuple, DataFrame], columns: tuple[str, ...], keys: list[str]) -> DataFrame:
    """The union of frames with their provenance as ``columns``; of rows with equal ``keys`` the last frame's stays."""
    out = None
    for k, (values, df) in enumerate(frames.items()):
        part = df.withColumns({c: F.lit(v) for c, v in zip(columns, values)} | {"_o": F.lit(k)})
        out = part if out is None else out.unionByName(part)
    return last_wins(out, keys, "_o").drop("_o")


def with_default(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Every row of ``left``, with nulls where ``right`` has no row."""
    return left.join(right, on, "left")


def pivot_map(df: DataFrame, key: str, tag: str, value: str, order: str) -> DataFrame:
    """``(key, attrs)``: a map of tags to values, the last of a tag's by ``order``."""
    one = df.groupBy(key, tag).agg(F.max_by(value, order).alias(value))
    return one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(tag, value)))).alias("attrs"))


def shards(df: DataFrame, key: str, most: int) -> DataFrame:
    """``(key, chunk)``: distinct keys in order, in chunks of ceil(n / most).

    Ranks come from a range partition and the partitions' sizes, so no task sorts all keys.
    """
    from termloom.functions.shared import shuffle_width, staged

    keys = df.select(key).distinct()
    n = shuffle_width(df.sparkSession)
    ordered = staged(keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), "shards")
    part = ordered.withColumn("_p", F.shiftright("_m", 33))
    sizes = [(r["_p"], r["n"], r["f"]) for r in part.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("f")).orderBy("_p").collect()]  # a row a partition
    total, base = 0, []
    for p, size, first in sizes:
        base.append((p, total - first))
        total += size
    chunk = max(1, -(-total // most))
    offsets = df.sparkSession.createDataFrame(base, "_p long, _b long")
    return part.join(F.broadcast(offsets), "_p").select(key, F.expr(f"(_m + _b) div {chunk}").alias("chunk"))


def search(terms: DataFrame, samples: DataFrame, types: DataFrame, term_id: str, sample_type: str | None = None) -> DataFrame:
    """Samples with a term, of one type if given: terms ⋈ samples ⋈ types on ``sample_id``, the term first."""
    hit = terms.where(F.col("term_id") == term_id).select("sample_id").distinct()
    kind = types if sample_type in (None, "all") else types.where(F.col("sample_type") == sample_type)
    return hit.join(samples, "sample_id").join(kind, "sample_id")


def resolve_term(names: DataFrame, asked: str, spaces: tuple = ("DOID", "UBERON", "CVCL", "CL", "EFO")) -> list[str]:
    """Ids of the terms of that name; without one, the text itself if it reads as an id of a known space."""
    found = [r["term_id"] for r in names.where(F.col("term_name") == asked).select("term_id").distinct().orderBy("term_id").collect()]
    prefix, _, digits = asked.partition(":")
    return found or ([asked] if prefix in spaces and digits.isdigit() else [])


def resolve_terms(names: DataFrame, asked: DataFrame, spaces: tuple = ("DOID", "UBERON", "CVCL", "CL", "EFO")) -> DataFrame:
    """:func:`resolve_term` for a table ``asked (asked)``: ``(asked, term_id)``, no row for a text that is neither."""
    a = asked.select("asked").distinct()
    met = a.join(names.select(F.col("term_name").alias("asked"), "term_id").distinct(), "asked", "left")
    is_id = F.col("asked").rlike("^(" + "|".join(spaces) + "):[0-9]+$")
    return met.withColumn("term_id", F.coalesce("term_id", F.when(is_id, F.col("asked")))).where("term_id is not null")


def override_links(*maps: DataFrame) -> DataFrame:
    """``(term_id, linked_id)``: of the maps that know a term, the last one's whole list. One shuffle, on the term."""
    ranked = [m.select("term_id", "linked_id", F.lit(i).alias("_rank")) for i, m in enumerate(maps)]
    every = ranked[0]
    for m in ranked[1:]:
        every = every.unionByName(m)
    last = F.max("_rank").over(Window.partitionBy("term_id"))
    return every.withColumn("_last", last).where("_rank = _last").select("term_id", "linked_id").distinct()


def first_per_group(df: DataFrame, group: str, item: str, skip: Column) -> DataFrame:
    """The least ``item`` of each ``group`` among rows where ``skip`` isn't true."""
    return df.where(~F.coalesce(skip, F.lit(False))).groupBy(group).agg(F.min(item).alias(item))


def linked_terms(a_names: DataFrame, b_names: DataFrame, kinds: tuple = ("TERM_NAME", "EXACT")) -> DataFrame:
    """``(b_id, a_id)``: terms of b linked to terms of a by an equal name or synonym of ``kinds``; columns ``(s, term_id, target)``."""
    a = a_names.where(F.col("target").isin(*kinds)).select("s", F.col("term_id").alias("a_id"))
    b = b_names.where(F.col("target").isin(*kinds)).select("s", F.col("term_id").alias("b_id"))
    return b.join(a, "s").select("b_id", "a_id").distinct()


def superterm_links(ancestors: DataFrame, links: DataFrame) -> DataFrame:
    """``(term_id, linked_id)``: what any ancestor of a term is linked to; ``links (term_id, linked_id)``."""
    return ancestors.join(links.withColumnRenamed("term_id", "ancestor"), "ancestor").select("term_id", "linked_id").distinct()


def implications(a_names: DataFrame, b_names: DataFrame) -> DataFrame:
    """``(b_id, a_id)``: a's string is a proper substring of b's with all its words among b's; b without a string in a.

    Pairs meet on a's rarest word in b, so only strings that share it are compared.
    """
    a = a_names.select("s", F.col("term_id").alias("a_id")).where("length(s) > 2").distinct()
    strays = b_names.join(a_names.select("s").distinct(), "s", "left_semi").select("term_id").distinct()
    b = b_names.join(strays, "term_id", "left_anti").select(F.col("s").alias("bs"), F.col("term_id").alias("b_id")).where("length(bs) > 2").distinct()
    bw = b.select("bs", "b_id", F.explode(F.array_distinct(F.split("bs", " "))).alias("w"))
    rare = bw.groupBy("w").count()
    aw = a.select("s", "a_id", F.explode(F.array_distinct(F.split("s", " "))).alias("w")).join(rare, "w", "left").fillna(0, ["count"])
    key = aw.groupBy("s", "a_id").agg(F.min(F.struct("count", "w"))["w"].alias("w"))
    met = key.join(bw, "w")
    inside = (F.size(F.array_except(F.split("s", " "), F.split("bs", " "))) == 0) & F.contains("bs", F.col("s")) & (F.col("s") != F.col("bs"))
    return met.where(inside).select("b_id", "a_id").distinct()


def subtract_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links (term_id, linked_id)`` without those of ``known``; a term whose every link is known has none left."""
    return links.select("term_id", "linked_id").distinct().join(known.select("term_id", "linked_id").distinct(), ["term_id", "linked_id"], "left_anti")


def without_bad_records(lines: DataFrame, key: str, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records ``(key, record)`` that parse as JSON of ``schema``, and ``(key, text, reason)`` of those that don't, as a table of their own.

    A bad record never fails its task. Nulls and texts that aren't an object are bad, too.
    """
    parsed = F.from_json(F.col(text), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.col(key).alias("key"), F.col(text).alias("text"), parsed.alias("record"))
    reason = F.when(F.col("text").isNull(), "null").when(F.col("record").isNull() | ~F.trim("text").startswith("{"), "no object").when(F.col("record._bad").isNotNull(), "does not parse")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("key", F.col("record").dropFields("_bad").alias("record")), rows.where("reason is not null").select("key", "text", "reason")


def enrich_synonyms(names: DataFrame, sets: DataFrame) -> DataFrame:
    """Members that a term lacks of the synonym sets ``(set_id, member)`` that one of its strings is in, as ``ENRICHED``."""
    mates = sets.join(sets.select("set_id", F.col("member").alias("mate")), "set_id")
    new = names.join(mates, names["s"] == mates["member"]).select("term_id", F.col("mate").alias("s")).distinct()
    return new.join(names.select("term_id", "s"), ["term_id", "s"], "left_anti").withColumn("target", F.lit("ENRICHED"))


def keyword_terms(names: DataFrame, keywords: list[str]) -> DataFrame:
    """``(term_id)`` of the terms with one of the keywords in a name or synonym ``s``."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains("s", F.lit(k))
    return names.where(hit).select("term_id").distinct()


def layout(c: Column) -> Column:
    return T.library_layout(c)
