"""Entity records: readers, and the view of the synthetic tables as business records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.functions import text
from kinmark.functions.records import prepare_batches
from kinmark.params import LinkParams
from kinmark.workers import let_workers_import

ENTITY_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_SCHEMA = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str = ENTITY_SCHEMA) -> DataFrame:
    """Tab-separated text with a header; every field is text and empty fields are empty, never null."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', enforceSchema=False)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])


def read_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of several sources, ``paths`` by role, with ``role`` and ``ordinal``. Ordinals follow the lines of a
    file: the start of a line's block, then its number within the task; two blocks of a task keep their order."""
    names = [column.split()[0] for column in ENTITY_SCHEMA.split(", ")]
    parts = []
    for role, path in paths.items():
        raw = spark.read.csv(path, sep="\t", header=True, schema=ENTITY_SCHEMA, quote='"', escape='"', enforceSchema=False)
        line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ordinal = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + line
        parts.append(
            raw.select(F.lit(role).alias("role"), *[F.coalesce(c, F.lit("")).alias(c) for c in names], ordinal.alias("ordinal"))
        )
    return reduce(DataFrame.unionByName, parts)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_ground_truth(read_tsv(spark, path, TRUTH_SCHEMA))


def parse_ground_truth(raw: DataFrame) -> DataFrame:
    """``(s1_id, matches)``: the comma list as a sorted set; an empty list for a record without matches."""
    ids = F.filter(
        F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), text.strip), lambda x: x != ""
    )
    return raw.select(F.col("source1_entity_id").alias("s1_id"), F.array_sort(F.array_distinct(ids)).alias("matches"))


def _role(number: Column) -> Column:
    return F.when(number % 3 == 0, "S1").when(number % 3 == 1, "S2").otherwise("S3")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as business records of three sources, with ``role`` and a stable ``ordinal``: the first line is the
    name, all the rest of the text the address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    role = _role(F.substring("source", 4, 10).cast("int"))
    first = F.substring_index("text", "\n", 1)
    return docs.select(
        role.alias("role"),
        F.concat(role, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        first.alias("business_name"),
        F.substring("text", F.length(first) + 2, F.length("text")).alias("business_address"),
        F.col("lang").alias("country"),
        F.col("doc_id").alias("ordinal"),
    )


def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as business records of three sources: the title is the name, the url the address, the language of the page
    its country. Whole short texts, for what is computed pair by pair."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    role = _role(F.col("page_id"))
    return pages.select(
        role.alias("role"),
        F.concat(role, F.lit("-"), F.col("page_id").cast("string")).alias("entity_id"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("business_name"),
        F.col("url").alias("business_address"),
        F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("country"),
        F.col("page_id").alias("ordinal"),
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as business records with house numbers and very many equal names; one country."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    role = _role(F.col("p_partkey"))
    return part.select(
        role.alias("role"),
        F.concat(role, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand").alias("business_address"),
        F.lit("US").alias("country"),
        F.col("p_partkey").alias("ordinal"),
    )


def with_some_unknown(entities: DataFrame) -> DataFrame:
    """Every seventh record without a country, to reach the pass over unknown countries."""
    return entities.withColumn("country", F.when(F.col("ordinal") % 7 == 0, F.lit(None)).otherwise(F.col("country")))


def silver_truth(entities: DataFrame) -> DataFrame:
    """``(s1_id, matches)`` for every record of S1: targets of equal country and normalised name."""
    keyed = entities.select("role", "entity_id", "country", text.normalize_text("business_name").alias("n"))
    s1 = keyed.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "n")
    targets = keyed.where("role <> 'S1'").select(F.col("entity_id").alias("m"), "country", "n")
    return (
        s1.join(targets, ["country", "n"], "left")
        .groupBy("s1_id")
        .agg(F.array_sort(F.collect_set("m")).alias("matches"))
    )


_MADE = ("n", "a", "c", "name_toks", "addr_toks", "ngrams")
#: What blocking reads of a prepared record.
BLOCKED = ("role", "entity_id", "ordinal", "c", "name_toks", "addr_toks", "ngrams")


def prepare(entities: DataFrame, params: LinkParams, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Entities with normalised texts and token arrays, computed once per record rather than once per pair.

    ``n``, ``a``, ``c``: name, standardised address, country. ``name_toks``, ``addr_toks`` and ``ngrams`` are lists
    for blocking, of the texts in the form that ``params.address_form`` names; ``feat_name_toks`` and
    ``feat_addr_toks`` are of the normalised texts always. ``keep`` names the columns to make and to pass on.
    """
    let_workers_import(entities.sparkSession)
    raw = params.address_form != "standardized"
    keep = keep or (*entities.columns, *_MADE, "feat_name_toks", "feat_addr_toks")
    # of standardised texts both kinds are the same lists
    same = {} if raw else {x: x.removeprefix("feat_") for x in ("feat_name_toks", "feat_addr_toks") if x in keep}
    needed = {same.get(x, x) for x in keep}
    passed = [x for x in entities.columns if x in needed]
    made = [x for x in (*_MADE, "feat_name_toks", "feat_addr_toks") if x in needed]
    texts = ("business_name", "business_address", "country")
    types = {f.name: f.dataType.simpleString() for f in entities.schema.fields}
    schema = [f"`{x}` {types[x]}" for x in passed] + [f"{x} {'string' if x in ('n', 'a', 'c') else 'array<string>'}" for x in made]
    rows = entities.select(*passed, *[x for x in texts if x not in passed]).mapInArrow(
        prepare_batches(passed, made, raw, params.ngram_size), ", ".join(schema)
    )
    return rows.select(*[F.col(same.get(x, x)).alias(x) for x in keep])
