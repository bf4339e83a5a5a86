"""Dictionary joins. Distinct token strings are matched, not token rows.

The dictionary is ``(s, term_id, target)``; a side is broadcast only by Spark itself, behind its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from termloom.functions import text as T
from termloom.functions.shared import staged


def exact_match(tokens: DataFrame, dictionary: DataFrame, tok: str = "tok", shortest: int = 3, numbers: bool = False) -> DataFrame:
    """``(tok, term_id, label)``: terms with the token as name, else those with it as a synonym.

    ``dictionary.target`` is TERM_NAME or a synonym type; a term matched by name gives no synonym labels. Tokens shorter
    than ``shortest`` and numbers aren't asked.
    """
    asked = tokens.select(F.col(tok).alias("tok")).distinct().where(F.length("tok") >= shortest)
    asked = asked if numbers else asked.where(~T.is_number(F.col("tok")))
    hits = asked.join(dictionary, asked["tok"] == dictionary["s"]).select("tok", "term_id", "target").distinct()
    named = F.max(F.col("target") == "TERM_NAME").over(Window.partitionBy("tok", "term_id"))
    label = F.when(F.col("target") == "TERM_NAME", "TERM_NAME").otherwise(F.concat("target", F.lit("_SYNONYM")))
    return hits.withColumn("_n", named).where("not _n or target = 'TERM_NAME'").select("tok", "term_id", label.alias("label"))


#: A piece at its place that more stored strings than this share isn't joined on; see :func:`fuzzy_match`.
COMMON = 200


def _shortened(c: str, most: int) -> str:
    """SQL: hashes of the string without any up to ``most`` of its characters, that is by which near strings meet."""
    n = f"length({c})"
    some = [f"array(xxhash64({c}))"]
    if most > 0:
        some.append(f"case when {n} < 1 then array() else transform(sequence(1, {n}), i -> xxhash64(concat(substring({c}, 1, i - 1), substring({c}, i + 1, {n})))) end")
    if most > 1:
        some.append(
            f"case when {n} < 2 then array() else flatten(transform(sequence(1, {n} - 1), i -> transform(sequence(i + 1, {n}), j -> "
            f"xxhash64(concat(substring({c}, 1, i - 1), substring({c}, i + 1, j - i - 1), substring({c}, j + 1, {n})))))) end"
        )
    return f"array_distinct(concat({', '.join(some)}))"


def fuzzy_match(tokens: DataFrame, dictionary: DataFrame, tok: str = "tok", shortest: int = 4, most: int = 2, ratio: float = 0.1, equal: bool = True) -> DataFrame:
    """``(tok, s, edit_dist)``: dictionary strings within ``most`` (0 to 2) edits and ``ratio`` of the longer length; the nearest only, ties kept.

    Below length 1 / ratio that means equality, a hash join. For longer strings the dictionary is repeated for the
    lengths around its own and for ``most`` + 1 pieces of each string, of which one must occur unchanged, so the join is
    on (length, piece); the distance is verified. Pieces that more than ``COMMON`` strings share, as the beginnings of
    serial names, would bring together all of these: strings with such a piece, and tokens that ask for one, meet by
    what is left of them without up to ``most`` characters instead, which only near strings share.
    """
    if not 0 <= most <= 2:
        raise ValueError("up to two edits")
    asked = tokens.select(F.col(tok).alias("tok")).distinct().where((F.length("tok") >= shortest) & ~T.is_number(F.col("tok")))
    strings = dictionary.select("s").distinct()
    floor = int(1 / ratio) - most
    pieces = most + 1
    key = ["size", "p", "piece"]
    cut = lambda c: f"transform(sequence(0, {most}), p -> struct(p as p, int(floor(length({c}) * p / {pieces})) as at, int(floor(length({c}) * (p + 1) / {pieces}) - floor(length({c}) * p / {pieces})) as n))"
    stored = strings.where(F.length("s") >= floor).select("s", F.length("s").alias("size"), F.inline(F.expr(cut("s")))).select("s", "size", "p", F.expr("substring(s, at + 1, n)").alias("piece"))
    stored = staged(stored, "fuzzy-pieces")
    common = staged(stored.groupBy(*key).count().where(F.col("count") > COMMON).select(*key), "fuzzy-common")
    asking = (
        asked.where(F.length("tok") >= floor)
        .select("tok", F.explode(F.expr(f"flatten(transform(sequence(greatest(1, length(tok) - {most}), length(tok) + {most}), z -> transform(sequence(0, {most}), p -> struct(z as z, p as p))))")).alias("k"))
        .select("tok", F.col("k.z").alias("size"), F.col("k.p").alias("p"), F.explode(F.expr(f"sequence(-{most}, {most})")).alias("shift"))
        .withColumn("at", F.expr(f"int(floor(size * p / {pieces})) + shift"))
        .withColumn("n", F.expr(f"int(floor(size * (p + 1) / {pieces}) - floor(size * p / {pieces}))"))
        .where("at >= 0 and at + n <= length(tok)")
        .select("tok", "size", "p", F.expr("substring(tok, at + 1, n)").alias("piece"))
        .distinct()
    )
    # sizes aren't estimated through explode: without the hint many rows could be broadcast as few
    near = asking.hint("merge").join(stored.join(common, key, "left_anti"), key).select("tok", "s")
    some = 1 / ratio * most - most  # shorter strings are within one edit at most
    left = lambda c: F.explode(F.expr(f"case when length({c}) >= {some} then {_shortened(c, most)} else {_shortened(c, min(most, 1))} end")).alias("left")
    of_common = stored.join(common, key, "left_semi").select("s").distinct().select("s", left("s"))
    for_common = asking.join(common, key, "left_semi").select("tok").distinct().select("tok", left("tok"))
    near = near.unionByName(for_common.hint("merge").join(of_common, "left").select("tok", "s")).distinct()
    far = near.where("tok <> s").withColumn("edit_dist", F.levenshtein("tok", "s", most))
    longer = F.greatest(F.length("tok"), F.length("s"))
    found = far.where((F.col("edit_dist") >= 0) & (F.col("edit_dist") / longer <= ratio) & (F.abs(F.length("tok") - F.length("s")) / longer <= ratio))
    if equal:
        same = asked.join(strings, asked["tok"] == strings["s"]).select("tok", "s", F.lit(0).alias("edit_dist"))
        found = found.unionByName(same)
    best = F.min("edit_dist").over(Window.partitionBy("tok"))
    return found.withColumn("_b", best).where("edit_dist = _b").drop("_b")
