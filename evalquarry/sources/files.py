"""Reading corpora, queries and judgments from files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per \\n-ended line; other line separators stay within strings."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, a single object or JSON lines, whichever the file is."""
    head = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "").select(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()).first()
    one = head is not None and not head[0]  # else the first line is an object of its own
    return spark.read.schema(schema).option("multiLine", True).json(path) if one else json_lines(spark, path, schema)


def corpus(spark: SparkSession, path: str, timestamp_field: str = "timestamp", metadata_fields: tuple[str, ...] = ()) -> DataFrame:
    """id, text and optional title, timestamp and metadata; pos keeps the corpus order."""
    extra = "".join(f", `{f}` string" for f in dict.fromkeys((timestamp_field, *metadata_fields)) if f not in ("id", "text", "title"))
    rows = json_lines(spark, path, f"id string, text string, title string{extra}")
    meta = F.map_filter(F.create_map(*(x for f in metadata_fields for x in (F.lit(f), F.col(f)))), lambda k, v: v.isNotNull()) if metadata_fields else F.lit(None).cast("map<string,string>")
    return rows.select(F.col("id").alias("doc_id"), "text", "title", F.to_timestamp(timestamp_field).alias("ts"), meta.alias("metadata"), F.monotonically_increasing_id().alias("pos"))


def queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, judgments): relevant_doc_ids is a list, of grade 1, or a map to grades."""
    rows = spark.read.text(path).select(F.parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    q = rows.select(F.coalesce(get("$.query_id", "string"), get("$.id", "string")).alias("query_id"), get("$.text", "string").alias("text"), "v")
    listed = q.select("query_id", F.explode(get("$.relevant_doc_ids", "array<string>")).alias("doc_id"), F.lit(1).alias("grade"))
    mapped = q.select("query_id", F.explode(get("$.relevant_doc_ids", "map<string,int>")).alias("doc_id", "grade"))
    return q.select("query_id", "text"), listed.unionByName(mapped)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments as whitespace text (query 0 doc grade, or query doc grade) or as JSON lines of
    pairs, lists or maps. The same pair with two grades is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text, json = lines.where(~F.trim("value").startswith("{")), lines.where(F.trim("value").startswith("{")).select(F.parse_json("value").alias("v"))
    part = F.split(F.trim("value"), r"\s+")
    four = F.size("p") >= 4
    plain = text.select(part.alias("p")).where(F.size("p") >= 3).select(
        F.element_at("p", 1).alias("query_id"), F.when(four, F.try_element_at("p", F.lit(3))).otherwise(F.element_at("p", 2)).alias("doc_id"),
        F.when(four, F.try_element_at("p", F.lit(4))).otherwise(F.element_at("p", 3)).cast("int").alias("grade"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    q = get("$.query_id", "string").alias("query_id")
    pairs = json.select(q, get("$.doc_id", "string").alias("doc_id"), F.coalesce(get("$.relevance", "int"), get("$.grade", "int"), get("$.score", "int"), F.lit(1)).alias("grade")).where("doc_id is not null")
    listed = json.select(q, F.explode(get("$.relevant_doc_ids", "array<string>")).alias("doc_id"), F.lit(1).alias("grade"))
    mapped = json.select(q, F.explode(get("$.relevant_doc_ids", "map<string,int>")).alias("doc_id", "grade"))
    rows = plain.unionByName(pairs).unionByName(listed).unionByName(mapped)
    each = rows.groupBy("query_id", "doc_id").agg(F.min("grade").alias("lo"), F.max("grade").alias("hi"))
    wrong = F.raise_error(F.concat(F.lit("contradicting grades for "), F.col("query_id"), F.lit(" "), F.col("doc_id")))
    return each.select("query_id", "doc_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(wrong.cast("int")).alias("grade"))


def merge_qrels(gold: DataFrame, judged: DataFrame, keep_greater: bool = False) -> DataFrame:
    """Union of both; on the same pair the judged grade, or the greater one."""
    g, j = gold.select("query_id", "doc_id", F.col("grade").alias("g")), judged.select("query_id", "doc_id", F.col("grade").alias("j"))
    both = F.greatest("g", "j") if keep_greater else F.coalesce("j", "g")
    return g.join(j, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", both.alias("grade"))


def resolved_conflicts(judgments: DataFrame, rule: str) -> DataFrame:
    """One grade per pair of rows (query_id, doc_id, grade, seq): max, first, last or error."""
    keys = ["query_id", "doc_id"]
    if rule == "error":
        bad = F.raise_error(F.concat(F.lit("two judgments of "), F.col("query_id"), F.lit(" "), F.col("doc_id"))).cast("int")
        return judgments.groupBy(*keys).agg(F.max("grade").alias("grade"), F.countDistinct("grade").alias("n")).select(*keys, F.when(F.col("n") == 1, F.col("grade")).otherwise(bad).alias("grade"))
    pick = {"max": F.max("grade"), "first": F.min_by("grade", "seq"), "last": F.max_by("grade", "seq")}[rule]
    return judgments.groupBy(*keys).agg(pick.alias("grade"))


def beir(spark: SparkSession, folder: str, split: str = "test", k: int = 100, max_queries: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, judgments) of an unpacked collection: corpus.jsonl, queries.jsonl and
    qrels/<split>.tsv. Judgments of grade 0 stay; queries without a judgment go."""
    judged = spark.read.schema("`query-id` string, `corpus-id` string, score int").option("sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")
    judged = judged.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("grade"))
    counts = judged.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n_relevant"), F.count("*").alias("n_judged"))
    q = json_lines(spark, f"{folder}/queries.jsonl", "_id string, text string").select(F.col("_id").alias("query_id"), "text").join(counts, "query_id").withColumn("k", F.lit(k))
    c = json_lines(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string").select(F.col("_id").alias("doc_id"), "title", "text")
    return (q if max_queries is None else q.orderBy("query_id").limit(max_queries)), c, judged


def in_memory(spark: SparkSession, queries_: list, corpus_: dict | list, qrels_: dict, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (texts or mappings), corpus (texts by id, or mappings) and judgments by query as tables."""
    from evalquarry.functions.identity import digest

    rows = []
    for q in queries_:
        q = q if isinstance(q, dict) else {"text": str(q)}
        rows.append((str(q.get("query_id", q.get("id", "q_" + digest(q["text"])[:10]))), q["text"], int(q.get("k", k))))
    docs = list(corpus_.items()) if isinstance(corpus_, dict) else [(str(d.get("doc_id", d.get("id"))), d.get("text")) for d in corpus_]
    judged = [(str(q), str(d), g) for q, got in qrels_.items() for d, g in (got.items() if isinstance(got, dict) else ((x, 1) for x in got))]
    return (
        spark.createDataFrame(rows, "query_id string, text string, k int"), spark.createDataFrame([(str(i), t) for i, t in docs], "doc_id string, text string"),
        spark.createDataFrame(judged, "query_id string, doc_id string, grade int"),
    )


def inputs(spark: SparkSession, queries_path: str, corpus_path: str, qrels_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of an evaluation; without a judgment file those in the query file."""
    q, inline = queries(spark, queries_path)
    return q, corpus(spark, corpus_path), inline if qrels_path is None else qrels(spark, qrels_path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Typed edges between documents; without a weight 1."""
    rows = json_lines(spark, path, "src string, dst string, type string, weight double")
    return rows.select("src", "dst", F.col("type").alias("edge_type"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def placed(rows: DataFrame, *order: object, name: str = "place") -> DataFrame:
    """Few rows (runs, operators, pages) with their place in an order."""
    from pyspark.sql import Window

    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def decoded(rows: DataFrame, column: str, *ids: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the JSON as a variant, rows whose JSON can't be read with their ids): one
    broken trace doesn't stop the rest, and is not lost."""
    tried = rows.withColumn("payload", F.try_parse_json(column))
    return tried.where("payload is not null").drop(column), tried.where("payload is null").drop("payload").withColumn("problem", F.concat_ws(" ", F.lit("unreadable"), *(F.col(i).cast("string") for i in ids)))
