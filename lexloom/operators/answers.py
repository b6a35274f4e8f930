"""Structured answers: prompts, parsing, validation and repair, training messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The answer's schema, its allowed labels, the padding sentence and the terms that answers must not use.
SCHEMA = (
    "query_id string, interpreted_need struct<category:string,use_case:string,positive_preferences:array<string>,negative_constraints:array<string>,"
    "visual_preferences:array<string>,uncertain_fields:array<string>>, product_judgements array<struct<product_id:string,role:string,evidence:array<string>,"
    "constraint_violations:array<string>,reason:string>>, decision string, customer_response string"
)
ROLES = ("exact", "substitute", "irrelevant")
DECISIONS = ("recommend_exact", "recommend_exact_with_warning", "recommend_substitute", "no_good_match", "ask_clarification")
PADDING = " Please let me know if you need more options."
FALLBACK = "I am sorry, but I am unable to generate a valid response right now. Please try again."
FORBIDDEN = ("price", "stock", "review", "rating", "shipping", "discount")
MIN_WORDS = 8


def validate(raw: DataFrame, with_products: bool = False) -> DataFrame:
    """(query_id, status, decision, n_judgements, roles, customer_response) of (query_id, raw, products array); with_products
    adds the judged products and those retrieved, before the response.

    Fences go, the query id is forced, short responses are padded, unknown roles become irrelevant and judgements of
    products that were not retrieved are dropped (one of the first product stands in if none is left). What can't be
    parsed, lacks a key or has an unknown decision falls back.
    """
    fenced = F.regexp_replace(F.regexp_replace("raw", r"^```(json)?", ""), r"`+$", "")
    x = raw.withColumn("cleaned", F.trim(F.regexp_replace(fenced, r"^\s+|\s+$", "")))
    x = x.withColumn("a", F.from_json("cleaned", SCHEMA))
    need = F.col("a.interpreted_need")
    ok = F.coalesce(
        F.col("a.query_id").isNotNull() & F.col("a.customer_response").isNotNull() & F.col("a.product_judgements").isNotNull() & F.col("a.decision").isin(*DECISIONS) & need["category"].isNotNull()
        & need["positive_preferences"].isNotNull() & need["negative_constraints"].isNotNull() & need["visual_preferences"].isNotNull() & need["uncertain_fields"].isNotNull(),
        F.lit(False),
    )
    words = F.size(F.filter(F.split("a.customer_response", r"\s+"), lambda w: w != ""))
    pads = F.greatest(F.ceil((MIN_WORDS - words) / 9), F.lit(0)).cast("int")
    roles = F.transform(F.filter("a.product_judgements", lambda j: F.array_contains("products", j["product_id"])), lambda j: F.when(j["role"].isin(*ROLES), j["role"]).otherwise("irrelevant"))
    ids = F.transform(F.filter("a.product_judgements", lambda j: F.array_contains("products", j["product_id"])), lambda j: j["product_id"])
    judged = F.when(ok & (F.size(ids) > 0), ids).otherwise(F.slice("products", 1, 1))
    kept = F.when(F.size(roles) == 0, F.array(F.lit("irrelevant"))).otherwise(roles)
    status = F.when(~ok, "fallback").when(F.col("raw") == F.col("cleaned"), "direct-valid").otherwise("schema-valid-after-light-repair")
    return x.select(
        "query_id",
        status.alias("status"),
        F.when(ok, F.col("a.decision")).otherwise("ask_clarification").alias("decision"),
        F.when(ok, F.size(kept)).otherwise(1).alias("n_judgements"),
        F.when(ok, F.array_join(kept, ",")).otherwise("irrelevant").alias("roles"),
        *([judged.alias("judged"), "products"] if with_products else []),
        F.when(ok, F.concat(F.col("a.customer_response"), F.repeat(F.lit(PADDING), pads))).otherwise(FALLBACK).alias("customer_response"),
    )


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def prompts(queries: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, prompt): the query, then a line for each result in rank order."""
    rows = results.join(catalog, "doc_id", "left").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("doc_id").cast("string"), F.lit(" | "), F.substring("features", 1, 200)).alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    image = F.when(F.col("query_type").isin("image", "image_text"), "\nThe customer sent a picture.").otherwise("") if "query_type" in queries.columns else F.lit("")
    return queries.join(rows, "query_id").select("query_id", F.concat(F.lit("Query: "), "text", image, F.lit("\nProducts:\n"), "lines").alias("prompt"))


def generate(requests: DataFrame, model, retries: int = 2) -> DataFrame:
    """Validated answers of (query_id, prompt, products). model maps (query_id, prompt, products, attempt) rows to (query_id, raw).
    Requests whose answer falls back are asked again, `retries` times at most; then the fallback stands."""
    open_, done = requests.select("query_id", "prompt", "products"), None
    for attempt in range(retries + 1):
        asked = open_.withColumn("attempt", F.lit(attempt))
        out = validate(model(asked).join(open_.select("query_id", "products"), "query_id")).withColumn("attempts", F.lit(attempt + 1)).checkpoint()
        good = out if attempt == retries else out.where("status <> 'fallback'")
        done = good if done is None else done.unionByName(good)
        open_ = open_.join(good.select("query_id"), "query_id", "left_anti")
    return done


def training_rows(answers: DataFrame, queries: DataFrame, reranked: DataFrame, catalog: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, messages): for each answer (query_id, answer) whose query (query_id, text, query_type) and reranked results
    (query_id, doc_id, rank) exist, a user message with the prompt and an assistant message with the answer, as JSON."""
    asked = prompts(queries, reranked.where(F.col("rank") <= k), catalog)
    both = answers.join(asked, "query_id").select("query_id", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("m"))
    return both.select("query_id", F.to_json("m").alias("messages"))


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): a conversation's turns in order as JSON training messages."""
    return turns.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"))
