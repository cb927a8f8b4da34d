"""Set and field scores, answer parsing, prompts, tuning examples, text generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sets, text
from ..operators import extraction, generation
from . import views
from .catalog import query
from .label_queries import _PREDICTED_SQL, _guessed
from .metric_queries import rounded


@query(
    "set_f1",
    views.with_views("labelled_docs")
    + _PREDICTED_SQL
    + """SELECT doc_id, round(CASE WHEN len(labels) = 0 AND len(guess) = 0 THEN 1.0
  ELSE coalesce(2.0 * len(list_intersect(labels, guess)) / nullif(len(labels) + len(guess), 0), 0) END, 9) AS f1
FROM predicted""",
)
def set_f1(spark, d):
    return rounded(_guessed(spark, d).select("doc_id", sets.set_f1("labels", "guess").alias("f1")))


# A turn is read as a record: its role, its place and its first word. The
# "prediction" drops or changes fields by the content of the turn.
_RECORDS = """WITH turns AS (
  SELECT conv_id, turn, role, text, lower(regexp_extract(text, '^[^ \\t\\n\\x0B\\f\\r]+')) AS opener,
    CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, length(text) > 150 AS is_long
  FROM conversations)
"""


def turns(spark, d):
    return views.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.lower(F.regexp_extract("text", r"^\S+", 0)).alias("opener"),
        F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("parity"),
        (F.length("text") > 150).alias("is_long"),
    )


def records(spark, d):
    """Gold and predicted structs with list and list-of-list fields."""
    none = F.expr("cast(array() as array<string>)")
    long = F.col("is_long")
    gold = F.struct(
        F.array("role", F.lit("speaker")).alias("role"),
        F.when(long, F.array("parity")).otherwise(none).alias("parity"),
        F.array(F.array("role", "parity")).alias("link"),
    )
    predicted = F.struct(
        F.array(F.concat(F.lit(" "), F.upper("role"), F.lit("\n"))).alias("role"),
        F.when(long, F.array("parity", "parity")).otherwise(none).alias("parity"),
        F.array(F.array("role", F.lit("EVEN "))).alias("link"),
        F.when(long, F.array("opener")).otherwise(none).alias("opener"),
    )
    return turns(spark, d).select(
        "conv_id", "turn", gold.alias("gold"), predicted.alias("predicted")
    )


_FIELD_F1 = _RECORDS + """, f AS (SELECT conv_id, turn, 2.0 * 1.0 * 0.5 / 1.5 AS f1_role,
  1.0 AS f1_parity, CASE WHEN parity = 'even' THEN 1.0 ELSE 0.0 END AS f1_link,
  CASE WHEN is_long THEN 0.0 ELSE 1.0 END AS f1_opener FROM turns),
m AS (SELECT *, (f1_role + f1_parity + f1_link + f1_opener) / 4 AS f1_macro FROM f)
"""


@query(
    "field_f1",
    _FIELD_F1
    + """SELECT conv_id, turn, round(f1_role::DOUBLE, 6) AS f1_role, f1_parity::DOUBLE AS f1_parity,
  f1_link::DOUBLE AS f1_link, f1_opener::DOUBLE AS f1_opener, round(f1_macro::DOUBLE, 6) AS f1_macro FROM m""",
)
def field_f1(spark, d):
    scored = extraction.with_field_f1(records(spark, d), "gold", "predicted")
    return rounded(scored.drop("gold", "predicted"), 6)


@query(
    "field_f1_dataset",
    _FIELD_F1 + "SELECT round(avg(f1_macro::DOUBLE), 6) AS f1_macro, count(*) AS n FROM m",
)
def field_f1_dataset(spark, d):
    scored = extraction.with_field_f1(records(spark, d), "gold", "predicted")
    return rounded(
        scored.agg(F.avg("f1_macro").alias("f1_macro"), F.count(F.lit(1)).alias("n")), 6
    )


@query(
    "field_names_union",
    """WITH p AS (SELECT doc_id, list_sort(list_filter(['lang', 'source', CASE WHEN n_chars > 1000 THEN 'long' END],
  lambda x: x IS NOT NULL)) AS g, list_sort(['lang', CASE WHEN lang = 'en' THEN 'topic' ELSE 'source' END]) AS q
  FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(g, q))), '|') AS fields,
  round((CASE WHEN list_contains(q, 'source') THEN 2 ELSE 1 END)::DOUBLE
    / len(list_distinct(list_concat(g, q))), 6) AS f1_macro FROM p""",
)
def field_names_union(spark, d):
    """Records with varying fields: the fields of both sides and their mean F1."""
    gold = F.map_concat(
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")),
        F.when(F.col("n_chars") > 1000, F.create_map(F.lit("long"), F.array(F.lit("yes")))).otherwise(
            F.expr("cast(map() as map<string, array<string>>)")
        ),
    )
    guess = F.when(
        F.col("lang") == "en",
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("topic"), F.array("source")),
    ).otherwise(
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array(F.upper("source")))
    )
    docs = views.table(spark, d, "documents").select(
        "doc_id", gold.alias("gold"), guess.alias("guess")
    )
    fields = F.array_sort(F.array_union(F.map_keys("gold"), F.map_keys("guess")))
    scored = extraction.with_map_f1(docs, "gold", "guess")
    return rounded(
        scored.select("doc_id", F.array_join(fields, "|").alias("fields"), "f1_macro"), 6
    )


def answers(spark, d):
    """Generated text around a JSON answer; long system turns give broken JSON."""
    t = turns(spark, d)
    gold = F.to_json(
        F.struct("role", "parity", F.when(F.col("is_long"), F.col("opener")).alias("opener")),
        {"ignoreNullFields": "false"},
    )
    answer = F.to_json(
        F.struct("role", F.lit("even").alias("parity"), F.concat("opener", F.lit(" ")).alias("opener"))
    )
    broken = F.col("is_long") & (F.col("role") == "assistant")
    return t.select(
        "conv_id",
        "turn",
        gold.alias("gold_json"),
        F.concat(
            F.lit("noise "),
            F.when(broken, F.replace(answer, F.lit(":"), F.lit("="))).otherwise(answer),
            F.lit(" tail"),
        ).alias("generated"),
    )


_ANSWERS = _RECORDS + """, answers AS (SELECT *, is_long AND role = 'assistant' AS broken FROM turns)
"""


@query(
    "extract_json",
    _ANSWERS
    + """SELECT conv_id, turn, NOT broken AS parsed, CASE WHEN NOT broken THEN role END AS role,
  CASE WHEN NOT broken THEN md5(opener || ' ') END AS opener_md5 FROM answers""",
)
def extract_json(spark, d):
    v = answers(spark, d).withColumn("v", text.extract_json("generated"))
    return v.select(
        "conv_id",
        "turn",
        F.col("v").isNotNull().alias("parsed"),
        F.try_variant_get("v", "$.role", "string").alias("role"),
        F.md5(F.try_variant_get("v", "$.opener", "string")).alias("opener_md5"),
    )


@query(
    "field_accuracy",
    _ANSWERS
    + """, h AS (SELECT count(*) AS n, count(*) FILTER (broken) AS parse_failures,
  count(*) FILTER (NOT broken) AS h0, count(*) FILTER (NOT broken AND parity = 'even') AS h1,
  count(*) FILTER (NOT broken AND is_long) AS h2 FROM answers)
SELECT 'role' AS field, h0 AS hits, round(h0 / n, 9) AS accuracy, n, parse_failures FROM h
UNION ALL SELECT 'parity', h1, round(h1 / n, 9), n, parse_failures FROM h
UNION ALL SELECT 'opener', h2, round(h2 / n, 9), n, parse_failures FROM h
UNION ALL SELECT 'ALL FIELDS (micro)', h0 + h1 + h2, round((h0 + h1 + h2) / (3 * n), 9), n, parse_failures FROM h""",
)
def field_accuracy(spark, d):
    return rounded(
        extraction.field_accuracy(
            answers(spark, d), "generated", "gold_json", ["role", "parity", "opener"]
        )
    )


_PROMPT_SQL = (
    "'" + text.EXTRACTION_PROMPT.replace("{fields}", "lang, source").replace("{text}", "' || text || '") + "'"
)
_EXAMPLES_SQL = f"""WITH e AS (SELECT doc_id, {_PROMPT_SQL} AS prompt,
  '{{"lang":"' || lang || '","source":"' || source || '"}}' AS completion FROM documents),
t AS (SELECT *, len(regexp_extract_all(prompt, '[^ \\t\\n\\x0B\\f\\r]+')) AS prompt_len FROM e)
"""


@query(
    "sft_examples",
    _EXAMPLES_SQL
    + """SELECT doc_id, md5(prompt) AS prompt_md5, completion, prompt_len::INT AS prompt_len,
  (prompt_len + 1)::INT AS total_len, least(prompt_len, 200)::INT AS supervised_from,
  least(prompt_len + 1, 200)::INT AS supervised_to, prompt_len >= 200 AS truncated FROM t""",
)
def sft_examples(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    ex = extraction.tuning_examples(docs, max_len=200, keep=["doc_id"])
    return ex.withColumn("prompt_md5", F.md5("prompt")).drop("prompt")


@query(
    "truncated_answers",
    _EXAMPLES_SQL
    + "SELECT count(*) AS n, count(*) FILTER (prompt_len >= 200) AS n_truncated FROM t",
)
def truncated_answers(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return extraction.truncated_answers(
        extraction.tuning_examples(docs, max_len=200, keep=["doc_id"])
    )


_PAIR_SQL = (
    "'" + text.PAIR_PROMPT.replace("{text}", "' || p_name || '").replace("{tag}", "' || tag_text || '") + "'"
)


@query(
    "pair_prompts",
    f"""WITH t AS (SELECT p_partkey, p_name, p_type AS tag,
  CASE p_type WHEN 'ECONOMY' THEN 'ECONOMY: low price range' WHEN 'LARGE' THEN 'LARGE: big parts'
    ELSE p_type END AS tag_text FROM part)
SELECT p_partkey, tag, md5({_PAIR_SQL}) AS prompt_md5, length({_PAIR_SQL})::INT AS prompt_chars FROM t""",
)
def pair_prompts(spark, d):
    """Prompt of every part with its type; two types have a description."""
    described = spark.createDataFrame(
        [("ECONOMY", "low price range"), ("LARGE", "big parts")], "tag string, description string"
    )
    tagged = views.table(spark, d, "part").select("p_partkey", "p_name", F.col("p_type").alias("tag"))
    prompt = text.pair_prompt("p_name", text.described_tag("tag", "description"))
    return tagged.join(described, "tag", "left").select(
        "p_partkey",
        "tag",
        F.md5(prompt).alias("prompt_md5"),
        F.length(prompt).alias("prompt_chars"),
    )


TEMPLATES = [
    ("positive", "The {brand} {type} part is great, shipped to {place}."),
    ("negative", "{place} got a broken {type} part from {brand}."),
    ("neutral", "{brand} sells {type} and {type} parts."),
]


def _pick_sql(what: str, values: str) -> str:
    return (
        f"list_extract({values}, (('0x' || substr(md5(concat_ws('|', '42', try_id, {what})), 1, 15))::BIGINT "
        f"% len({values}))::INT + 1)"
    )


_P = {k: "v." + k for k in ("brand", "type", "place")}
_GENERATE_SQL = f"""v AS (
  SELECT (SELECT list(DISTINCT p_brand ORDER BY p_brand) FROM part) AS brand,
    (SELECT list(DISTINCT p_type ORDER BY p_type) FROM part) AS type,
    (SELECT list(DISTINCT n_name ORDER BY n_name) FROM nation) AS place),
c AS (SELECT try_id, {_pick_sql("'template'", "['positive', 'negative', 'neutral']")} AS bucket,
    {_pick_sql("'positive', '0'", "v.brand")} AS a0, {_pick_sql("'positive', '1'", "v.type")} AS a1,
    {_pick_sql("'positive', '2'", "v.place")} AS a2,
    {_pick_sql("'negative', '0'", "v.place")} AS b0, {_pick_sql("'negative', '1'", "v.type")} AS b1,
    {_pick_sql("'negative', '2'", "v.brand")} AS b2,
    {_pick_sql("'neutral', '0'", "v.brand")} AS n0, {_pick_sql("'neutral', '1'", "v.type")} AS n1,
    {_pick_sql("'neutral', '2'", "v.type")} AS n2
  FROM tries, v),
t AS (SELECT try_id, bucket AS label_key, CASE bucket
    WHEN 'positive' THEN 'The ' || a0 || ' ' || a1 || ' part is great, shipped to ' || a2 || '.'
    WHEN 'negative' THEN b0 || ' got a broken ' || b1 || ' part from ' || b2 || '.'
    ELSE n0 || ' sells ' || n1 || ' and ' || n2 || ' parts.' END AS text FROM c)
"""


_CUSTOMER_TRIES = "WITH tries AS (SELECT c_custkey AS try_id FROM customer),\n"


def _slots(spark, d):
    part = views.table(spark, d, "part")
    return generation.slot_table(
        {
            "brand": (part, "p_brand"),
            "type": (part, "p_type"),
            "place": (views.table(spark, d, "nation"), "n_name"),
        }
    )


@query(
    "generate_texts",
    _CUSTOMER_TRIES
    + _GENERATE_SQL
    + "SELECT text, min(try_id) AS c_custkey, arg_min(label_key, try_id) AS label_key FROM t GROUP BY text",
)
def generate_texts(spark, d):
    """Labelled texts from templates; one try per customer, slots filled from the tables."""
    tries = views.table(spark, d, "customer").select("c_custkey")
    made = generation.filled_from_table(tries, "c_custkey", TEMPLATES, _slots(spark, d), views.SEED)
    return generation.unique_texts(made, "c_custkey")


@query(
    "generate_new_texts",
    """WITH goal AS (SELECT count(*) // 10 AS n FROM customer),
tries AS (SELECT unnest(range(0, n * 50)) AS try_id FROM goal),
"""
    + _GENERATE_SQL
    + """, once AS (SELECT text, min(try_id) AS try_id, arg_min(label_key, try_id) AS label_key FROM t GROUP BY text),
fresh AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', try_id)), try_id) AS rn
  FROM once WHERE text NOT IN (SELECT text FROM t WHERE try_id IN (SELECT c_custkey FROM customer)))
SELECT text, try_id, label_key FROM fresh, goal WHERE rn <= n""",
)
def generate_new_texts(spark, d):
    """A text for every tenth customer, none of them among those of ``generate_texts``.

    Templates and slots make a fixed number of texts, so many customers leave fewer new ones
    than that, or none; then all of them are returned, as the SQL does.
    """
    n = views.table(spark, d, "customer").count() // 10
    known = generate_texts(spark, d)
    return generation.generate(spark, n, TEMPLATES, _slots(spark, d), views.SEED, avoid=known, fewer=True)
