"""License scans by canonical digest lookup.

A text is brought to a canonical form - A-Z in lower case, lines that begin with a copyright mark left out, punctuation
and blanks as one space, equivalent spellings as one - and the digest of the whole of it is looked up among the digests
of known licences, by a hash join. It is done for the entire text and for each entire line, since a notice mostly stands
as a line of its own. No part of a text or line is ever matched. Texts that hold none of the stems which every known
text holds (checked when the table is made) can't match and aren't brought to the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.llm.common import LOWER, UPPER, narrow, table
from termloom.llm.license_texts import KNOWN, KNOWN_DIGESTS

#: Equivalent spellings, as stems of canonical words.
SPELLINGS = (("licenc", "licens"), ("authoris", "authoriz"), ("organis", "organiz"), ("favour", "favor"), ("non infring", "noninfring"), ("judgement", "judgment"), ("merchantib", "merchantab"))
STEM = "(?i)licen[sc]|permission|warrant|redistribut"
#: More known texts than this aren't broadcast.
BROADCAST_ROWS = 20_000


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", "\n")
    out = F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")
    for there, here in SPELLINGS:
        out = F.replace(out, F.lit(there), F.lit(here))
    return F.trim(out)


def known_digests(spark: SparkSession, known: tuple = KNOWN, digests: tuple = KNOWN_DIGESTS) -> DataFrame:
    """``(digest, license)`` of known texts and of texts known by their digest; of several licences with one text the first by name."""
    import re

    for name, text in known:
        if not re.search(STEM, text):
            raise ValueError(f"a text of {name} holds no stem of {STEM}")
    texts = spark.createDataFrame(list(known), "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    return texts.unionByName(spark.createDataFrame(list(digests), "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple = KNOWN, digests: tuple = KNOWN_DIGESTS) -> DataFrame:
    """``(doc_id, license, notices, n_notices)`` for every row.

    ``license``: what the entire text is, or null. ``notices``: the licences that entire lines are, sorted, each once,
    with commas; empty without any. ``n_notices``: the number of such lines. Null and empty texts match nothing; rows
    with null or repeated ids get a row each; an empty table gives no rows.

    Texts are read once and never shuffled: a written table holds each row's digests, that of the entire text first.
    Only digests that are known leave the join, and they meet their rows by row number.
    """
    spark = docs.sparkSession
    names = known_digests(spark, known, digests)
    if len(known) + len(digests) <= BROADCAST_ROWS:
        names = F.broadcast(names)
    digest = lambda unit: F.sha2(canonical(unit), 256)
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(STEM))
    units = F.when(F.col("_t").rlike(STEM), F.concat(F.array(digest(F.col("_t"))), F.transform(lines, digest)))
    rows = staged(narrow(docs, _id=id_col, _t=text_col).select("_id", F.monotonically_increasing_id().alias("_row"), units.alias("_units")), "license-digests")
    found = (
        rows.where("_units is not null")
        .select("_row", F.posexplode("_units").alias("at", "digest"))
        .join(names, "digest")
        .groupBy(F.col("_row").alias("_found"))
        .agg(
            F.min(F.when(F.col("at") == 0, F.col("license"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("at") > 0, F.col("license")))), ",").alias("notices"),
            F.count(F.when(F.col("at") > 0, 1)).alias("n_notices"),
        )
    )
    return rows.select("_id", "_row").join(found, F.col("_row") == F.col("_found"), "left").select(
        F.col("_id").alias("doc_id"), "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices")
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _canonical_sql(x: str) -> str:
    out = f"translate({x}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', chr(10), 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
    for there, here in SPELLINGS:
        out = f"replace({out}, '{there}', '{here}')"
    return f"trim({out})"


def _oracle() -> str:
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for n, t in KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in KNOWN_DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256({_canonical_sql('t')}) AS digest FROM (VALUES {rows}) k(license, t) UNION ALL SELECT * FROM (VALUES {digests}) d(license, digest))
  GROUP BY 1
),
units AS (
  SELECT doc_id, true AS whole, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents
), found AS (
  SELECT doc_id, min(CASE WHEN whole THEN license END) AS license,
         string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole) AS notices,
         count(*) FILTER (WHERE NOT whole) AS n_notices
  FROM (SELECT doc_id, whole, sha256({_canonical_sql('unit')}) AS digest FROM units WHERE regexp_matches(unit, '{STEM}')) JOIN known USING (digest)
  GROUP BY doc_id
)
SELECT d.doc_id, f.license, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0)::BIGINT AS n_notices
FROM documents d LEFT JOIN found f USING (doc_id)
"""


OP6_SQL = _oracle()
