"""Readers of samples, vocabularies and lexicons, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _pairs(m: str) -> Column:
    """The entries of a parsed map; of equal keys the last counts, as JSON readers have it."""
    placed = f"array_sort(transform(map_entries({m}), (e, i) -> named_struct('key', e.key, 'i', i, 'value', e.value)))"
    last = f"filter({placed}, (e, i) -> not coalesce(get({placed}, i + 1).key = e.key, false))"
    return F.expr(f"transform({last}, e -> named_struct('key', e.key, 'value', e.value))")


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, kv_key, kv_value)`` of a JSON list of flat maps; the sample is its place in the list."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<map<string,string>>", {"mode": "PERMISSIVE"}).alias("a"))
    return raw.select(F.posexplode("a").alias("sample_id", "m")).select("sample_id", F.inline(_pairs("m")).alias("kv_key", "kv_value"))


def count_sample_list(spark: SparkSession, path: str) -> int:
    """How many samples a JSON list has, those without a pair too."""
    return spark.read.text(path, wholetext=True).select(F.size(F.from_json("value", "array<map<string,string>>")).alias("n")).first()["n"]


def read_sample_map(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, kv_key, kv_value)`` of JSON like accession -> tag -> value."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return raw.select(F.explode("m").alias("sample_id", "t")).select("sample_id", F.inline(_pairs("t")).alias("kv_key", "kv_value"))


def read_sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, kv_key, kv_value)`` of lines ``{"sample_id": .., "attributes": {..}}``: files of any size, read in parallel."""
    rows = spark.read.text(path).select(F.from_json("value", "sample_id string, attributes map<string,string>").alias("r")).where("r.sample_id is not null")
    return rows.select(F.col("r.sample_id").alias("sample_id"), F.col("r.attributes").alias("t")).select("sample_id", F.inline(_pairs("t")).alias("kv_key", "kv_value"))


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id)`` of JSON with the list ``sample_accessions``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "sample_accessions array<string>").alias("r"))
    return raw.select(F.explode("r.sample_accessions").alias("sample_id"))


def gather_outputs(spark: SparkSession, folder: str, name: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """``(sample_id, json)`` of the JSON objects that jobs left in files ``name`` below ``folder``, and ``(file)`` of those that can't be read.

    Of a sample in several files the last by path counts. A file is a job's output, one row here.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    raw = found.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"), F.col("value"))
    good = F.col("m").isNotNull() & F.trim("value").startswith("{")
    rows = raw.where(good).select("file", F.explode("m").alias("sample_id", "json"))
    return rows.groupBy("sample_id").agg(F.max_by("json", "file").alias("json")), raw.where(~good).select("file")


def read_table(spark: SparkSession, source: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A relational table: Parquet, ORC, JSON or CSV files at ``source``, or with ``kind='jdbc'`` the table ``source`` of ``url``.

    For a database give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` with a large table, so that
    it is read by as many tasks; filters and columns are pushed down to it. CSV without a schema has columns of text.
    """
    reader = spark.read.format(kind).options(**options)
    if kind == "jdbc":
        return reader.option("dbtable", source).load()
    if kind == "csv" and "header" not in options:
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(source)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Merges ``new`` into the Parquet table at ``path``: rows of equal ``keys`` are replaced, others stay or are added.

    Of rows of ``new`` with equal keys one stays, that with the greatest other values. The merged table is written beside
    the old one before it takes its place.
    """
    from pyspark.errors import AnalysisException

    from termloom.functions.shared import staged
    from termloom.operators.relational import last_wins

    rows = new.withColumn("_new", F.lit(True))
    try:
        rows = spark.read.parquet(path).withColumn("_new", F.lit(False)).unionByName(rows)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    merged = staged(last_wins(rows, keys, "_new").drop("_new").select(*new.columns), "upsert")
    merged.write.mode("overwrite").parquet(path)


def read_obo(spark: SparkSession, path: str, ont: str, idspaces: list[str] | None = None, obsolete: bool = False) -> dict[str, DataFrame]:
    """The tables ``term``, ``synonym``, ``rel``, ``subset``, ``xref`` and ``property`` of an OBO file.

    Stanzas are parted by blank lines, with blanks in them or carriage returns or not; those of terms count that have a name, aren't obsolete and are in ``idspaces``.
    ``is_a`` parents outside ``idspaces`` are left out, other relationships aren't.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value"))  # a vocabulary's file
    stanza = whole.where(F.col("value").rlike(r"(?s)^\s*\[Term\]")).withColumn("_n", F.monotonically_increasing_id())
    lines = stanza.select("_n", F.posexplode(F.split("value", r"\r?\n")).alias("_p", "line")).where(F.contains("line", F.lit(":")))
    tags = lines.select("_n", "_p", F.trim(F.split("line", ":", 2)[0]).alias("tag"), F.trim(F.split("line", ":", 2)[1]).alias("v"))
    first = lambda name: F.min_by(F.when(F.col("tag") == name, F.col("v")), F.when(F.col("tag") == name, F.col("_p")))
    quoted = F.regexp_extract("v", r'"((?:\\.|[^"\\])*)"', 1)
    head = tags.groupBy("_n").agg(
        first("id").alias("term_id"), first("name").alias("name"), first("def").alias("_d"), first("comment").alias("comment"), F.coalesce(first("is_obsolete"), F.lit("false")).alias("_o")
    )
    space = F.split_part("term_id", F.lit(":"), F.lit(1))
    kept = head.where("name is not null and term_id is not null").where(F.lit(True) if obsolete else F.col("_o") != "true")
    kept = kept.where(space.isin(*idspaces)) if idspaces else kept
    term = kept.select(F.lit(ont).alias("ont"), "term_id", space.alias("idspace"), "name", F.regexp_extract("_d", r'"((?:\\.|[^"\\])*)"', 1).alias("definition"), "comment", (F.col("_o") == "true").alias("obsolete"))
    own = tags.join(kept.select("_n", "term_id"), "_n")
    bare = F.trim(F.split_part("v", F.lit("!"), F.lit(1)))
    is_a = own.where("tag = 'is_a'").select("term_id", F.lit("is_a").alias("rel"), bare.alias("parent"))
    if idspaces:
        is_a = is_a.where(F.split_part("parent", F.lit(":"), F.lit(1)).isin(*idspaces))
    other = own.where("tag = 'relationship'").select("term_id", F.split_part(bare, F.lit(" "), F.lit(1)).alias("rel"), F.trim(F.split(bare, r"\s+")[1]).alias("parent"))
    return {
        "term": term,
        "synonym": own.where("tag = 'synonym'").select(F.lit(ont).alias("ont"), "term_id", quoted.alias("syn"), F.regexp_extract("v", r'"(?:\\.|[^"\\])*"\s+(\S+)', 1).alias("syn_type")).where("syn <> ''").distinct(),
        "rel": is_a.unionByName(other).select(F.lit(ont).alias("ont"), F.col("term_id").alias("child"), "rel", "parent").distinct(),
        "subset": own.where("tag = 'subset'").select(F.lit(ont).alias("ont"), "term_id", bare.alias("subset")).distinct(),
        "xref": own.where("tag = 'xref'").select(F.lit(ont).alias("ont"), "term_id", bare.alias("xref")).distinct(),
        "property": own.where("tag = 'property_value'").select(F.lit(ont).alias("ont"), "term_id", F.split_part("v", F.lit(" "), F.lit(1)).alias("prop"), F.when(quoted != "", quoted).otherwise(F.split_part("v", F.lit(" "), F.lit(2))).alias("val")).distinct(),
    }


def dictionary(obo: dict[str, DataFrame], removed: DataFrame | None = None) -> DataFrame:
    """``(s, term_id, target)``: names and synonyms, without ``removed (term_id, s)``."""
    names = obo["term"].select(F.col("name").alias("s"), "term_id", F.lit("TERM_NAME").alias("target"))
    syns = obo["synonym"].select(F.col("syn").alias("s"), "term_id", F.col("syn_type").alias("target"))
    if removed is not None:
        syns = syns.join(removed, ["term_id", "s"], "left_anti").select("s", "term_id", "target")
    return names.unionByName(syns).distinct()


def rename_spaces(spark: SparkSession, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Lines with literal replacements in turn, e.g. ``("CVCL_", "CVCL:")``; an earlier result is replaced again if it fits."""
    df = spark.read.text(path)
    for there, here in rules:
        df = df.withColumn("value", F.replace("value", F.lit(there), F.lit(here)))
    return df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(eui, base)`` of stanzas ``{base=.. entry=E.. }``."""
    raw = spark.read.text(path, lineSep="\n}")
    eui, base = F.regexp_extract("value", r"(?m)^\s*entry=([^=\n]*)", 1), F.regexp_extract("value", r"(?m)^\s*\{?base=([^=\n]*)", 1)
    return raw.select(eui.alias("eui"), base.alias("base")).where("eui <> '' and base <> ''")


def read_variants(spark: SparkSession, path: str, kind: str, lexicon: DataFrame, column: int = 1) -> DataFrame:
    """``(eui, kind, variant)`` of bar-separated rows of known entries; inflections equal to the base are left out."""
    parts = spark.read.text(path).select(F.split("value", r"\|").alias("p")).where(F.size("p") > column)
    rows = parts.select(F.col("p")[0].alias("eui"), F.lit(kind).alias("kind"), F.col("p")[column].alias("variant")).join(lexicon, "eui")
    return (rows.where("variant <> base") if kind == "inflection" else rows).select("eui", "kind", "variant").distinct()


def assemble_lexicon(lexicon: DataFrame, *variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``forms (form, eui)`` and ``variants (eui, kind, variant)``, the base a variant of its own kind."""
    out = lexicon.select("eui", F.lit("base").alias("kind"), F.col("base").alias("variant"))
    for v in variants:
        out = out.unionByName(v)
    return out.select(F.col("variant").alias("form"), "eui").distinct(), out.distinct()


def read_lexicon_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The forms and variants of a folder's files of entries, spellings, inflections, nominalizations and trademarks."""
    lex = read_lexicon(spark, f"{folder}/LEXICON")
    kinds = (("LRSPL", "spelling", 1), ("LRAGR", "inflection", 1), ("LRNOM", "nominalization", 1), ("LRTRM", "trademark", 2))
    return assemble_lexicon(lex, *[read_variants(spark, f"{folder}/{name}", kind, lex, column) for name, kind, column in kinds])


def rows_as_tsv(df: DataFrame, columns: list[str], confidence: str | None = None, places: int = 3) -> DataFrame:
    """``(line)``: tab-separated values, the confidence with fixed places; nulls are empty."""
    text = lambda c: F.format_string(f"%.{places}f", c) if c == confidence else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat_ws("\t", *[text(c) for c in columns]).alias("line"))


def rows_as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(line)``: one JSON object a row, keys in order of name."""
    return df.select(F.to_json(F.struct(*sorted(columns))).alias("line"))


def pretty_json(value) -> str:
    """JSON as people read it: four blanks a level, keys in order. For what the driver holds anyway, like the command line's output."""
    import json

    return json.dumps(value, indent=4, sort_keys=True, separators=(",", ": "))


def search_page(rows: DataFrame, columns: list[str], error: str | None = None):
    """Pieces of text of one JSON object, ``error_message`` and the list ``search_results``; rows stream through, none is held."""
    import json

    yield '{"error_message": ' + json.dumps(error) + ', "search_results": ['
    for i, r in enumerate(rows_as_json(rows, columns).toLocalIterator()):
        yield (", " if i else "") + r["line"]
    yield "]}"


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A Parquet table in place of any that was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
