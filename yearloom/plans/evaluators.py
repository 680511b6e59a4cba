"""Evaluators end to end. Lens: the numbers of an embedding are the logits and losses that a model left for an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.operators import chat as C
from yearloom.operators import evaluators as E
from yearloom.operators import joins as J
from yearloom.plans.assembly import _CELLS, _cells, fewshot
from yearloom.plans.registry import SQL, query
from yearloom.session import table

_SCORED = """models AS (SELECT DISTINCT year AS model_year FROM train WHERE year IS NOT NULL), nv AS (SELECT count(*) AS n FROM embeddings),
 pol AS (SELECT event_id, event_year, domain, row_number() OVER (ORDER BY event_id) AS no FROM battery),
 asked AS (SELECT model_year, event_id, domain, v AS variant, (no * 3 + v + model_year) % n AS vec_id FROM models, pol, nv, range(0, 3) r(v) WHERE event_year BETWEEN model_year - 10 AND model_year + 10),
 lg AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 ex AS (SELECT vec_id, list_transform(v[1:2], lambda x: exp(x - list_max(v[1:2]))) AS a, list_transform(v[3:7], lambda x: exp(x - list_max(v[3:7]))) AS b, v FROM lg),
 sc AS (SELECT vec_id, a[1] / list_sum(a) AS p, (b[1] + 0.5 * b[2] - 0.5 * b[4] - b[5]) / list_sum(b) AS s, v FROM ex)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _scores(spark: SparkSession, d: str, variants: int) -> DataFrame:
    """model_year, event_id, variant and logits for every policy near a model's year. The battery is fixed, its numbering small."""
    models = table(spark, d, "train").where("year IS NOT NULL").select(F.col("year").alias("model_year")).distinct()
    policies = table(spark, d, "battery").withColumn("no", F.row_number().over(Window.orderBy("event_id")))
    asked = J.year_window(models, policies.where("event_year IS NOT NULL").select("event_id", "no", F.col("event_year").alias("enactment_year")), 10, 10)
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    asked = asked.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).join(F.broadcast(n))
    keyed = asked.withColumn("vec_id", (F.col("no") * 3 + F.col("variant") + F.col("model_year")) % F.col("n"))
    return keyed.join(_vectors(spark, d), "vec_id").select("model_year", "event_id", "variant", F.slice("v", 1, 2).alias("yes_no"), F.slice("v", 3, 5).alias("scale"), F.col("v")[0].alias("log_true"), F.col("v")[1].alias("log_false"))


@query(f"WITH {_SCORED} SELECT model_year, event_id, round(p, 6) AS p_yes, round(s, 6) AS score FROM asked JOIN sc USING (vec_id) WHERE variant = 0")
def eval_policy_battery(spark: SparkSession, d: str) -> DataFrame:
    return E.get("policy_battery")(table(spark, d, "battery"), _scores(spark, d, 1), ["model_year"])


@query(f"WITH {_SCORED} SELECT model_year, event_id, round(p, 6) AS p_yes, round(s, 6) AS score FROM asked JOIN sc USING (vec_id) WHERE variant = 0 AND event_id IN ('ev-001', 'ev-003', 'ev-010')")
def eval_stated_policies(spark: SparkSession, d: str) -> DataFrame:
    return E.get("policy_battery")(table(spark, d, "battery"), _scores(spark, d, 1), ["model_year"], only=["ev-001", "ev-003", "ev-010"])


@query(f"WITH {_SCORED} SELECT model_year, event_id, round(avg(p), 6) AS mean_p_yes, round(stddev_samp(p), 6) AS std_p_yes, count(*) AS n_variants, round(avg(s), 6) AS mean_score FROM asked JOIN sc USING (vec_id) GROUP BY 1, 2")
def eval_policy_variants(spark: SparkSession, d: str) -> DataFrame:
    return E.get("policy_battery_variants")(table(spark, d, "battery"), _scores(spark, d, 3), ["model_year"])


@query(f"WITH {_SCORED} SELECT model_year, event_id, round(exp(v[1]) / (exp(v[1]) + exp(v[2])), 6) AS p_true FROM asked JOIN sc USING (vec_id) WHERE variant = 0")
def eval_policy_probe(spark: SparkSession, d: str) -> DataFrame:
    return E.get("policy_probe")(table(spark, d, "battery"), _scores(spark, d, 1), ["model_year"])


_ITEMS = "it AS (SELECT item_id, split_part(item_id, '-', 1) AS suite, question, expected, row_number() OVER (ORDER BY item_id) AS no FROM heldout), lg AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), j AS (SELECT * FROM it JOIN lg ON vec_id = no)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items with their suite and vector; the table is fixed."""
    numbered = table(spark, d, "heldout").withColumn("suite", F.substring_index("item_id", "-", 1)).withColumn("no", F.row_number().over(Window.orderBy("item_id")).cast("long"))
    vectors = _vectors(spark, d).withColumnRenamed("vec_id", "no").join(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("no"), "label"), "no")
    return numbered.join(vectors, "no")


_ACCURACY = "count(*) AS n, count(*) FILTER (ok) AS n_correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy"


@query(rf"""WITH {_ITEMS}, r AS (SELECT suite, TRY_CAST(replace(regexp_extract(expected, '#### (-?[0-9.,]+)', 1), ',', '') AS DOUBLE) AS gold, CASE WHEN label % 2 = 0 THEN TRY_CAST(replace(regexp_extract(expected, '#### (-?[0-9.,]+)', 1), ',', '') AS DOUBLE) ELSE 1 END AS given FROM j WHERE expected LIKE '%####%'),
 o AS (SELECT suite, gold = given AS ok FROM r) SELECT suite, {_ACCURACY} FROM o GROUP BY suite""")
def eval_gsm8k(spark: SparkSession, d: str) -> DataFrame:
    """Items with a marked number, and replies that state it for even labels only, after a number that does not count."""
    items = _items(spark, d)
    last = F.when(F.col("label") % 2 == 0, F.concat(F.col("expected"), F.lit(".0"))).otherwise(F.lit("#### 1"))
    return E.get("gsm8k")(items, items.select("item_id", F.concat(F.lit("First #### 7, then\n"), last).alias("reply")), ["suite"])


@query(f"WITH {_ITEMS}, o AS (SELECT suite, list_position(v[1:4], list_max(v[1:4])) = instr('ABCD', expected) AS ok FROM j WHERE expected IN ('A', 'B', 'C', 'D')) SELECT suite, {_ACCURACY} FROM o GROUP BY suite")
def eval_choice(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return E.get("choice")(items, items.select("item_id", F.slice("v", 1, 4).alias("logprobs")), ["suite"])


@query(f"WITH {_ITEMS}, m AS (SELECT suite, expected, [list_avg(v[3:6]), list_avg(v[9:12]), list_avg(v[15:18]), list_avg(v[21:24])] AS l FROM j WHERE expected IN ('A', 'B', 'C', 'D')), o AS (SELECT suite, list_position(l, list_min(l)) = instr('ABCD', expected) AS ok FROM m) SELECT suite, {_ACCURACY} FROM o GROUP BY suite")
def eval_core_task(spark: SparkSession, d: str) -> DataFrame:
    """Six losses an option, of which the first two belong to what the options share."""
    items = _items(spark, d)
    losses = F.array(*[F.slice("v", 6 * i + 1, 6) for i in range(4)])
    return E.get("core_task")(items, items.select("item_id", losses.alias("losses"), F.lit(2).alias("start")), ["suite"])


@query(f"""WITH fs AS ({SQL['fewshot']}) SELECT i.item_id, md5(string_agg(s.question || chr(10) || 'Answer: ' || s.expected, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || any_value(i.question) || chr(10) || 'Answer:') AS digest
 FROM fs JOIN heldout s ON s.item_id = fs.shot JOIN heldout i ON i.item_id = fs.item_id GROUP BY i.item_id""")
def few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    return E.few_shot_prompts(table(spark, d, "heldout"), fewshot(spark, d)).select("item_id", F.md5("prompt").alias("digest"))


@query("SELECT doc_id, md5('Write 3 texts like this one: ' || text || chr(10) || 'Keep {tone}.') AS digest FROM documents WHERE text IS NOT NULL")
def template_prompts(spark: SparkSession, d: str) -> DataFrame:
    made = E.rendered_template("Write {n_per_seed} texts like this one: {seed}\nKeep {tone}.", n_per_seed=F.lit(3), seed=F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(made).alias("digest"))


@query(f"WITH {_CELLS} SELECT year, x, backend, (row_number() OVER (ORDER BY year, x, backend) - 1) % 4 AS shard FROM cells")
def cell_shards(spark: SparkSession, d: str) -> DataFrame:
    """Cells dealt to shards in turn; there are a few for each year."""
    nth = F.row_number().over(Window.orderBy("year", "x", "backend")) - 1
    return _cells(spark, d).select("year", "x", "backend", (nth % 4).cast("long").alias("shard"))


_FORM = r"'^policy_(\d{4})_([a-z]+)_.*_n(\d+)'"


@query(f"""WITH {_CELLS}, n AS (SELECT TRY_CAST(regexp_extract(experiment, {_FORM}, 1) AS INTEGER) AS year, regexp_extract(experiment, {_FORM}, 2) AS backend, TRY_CAST(regexp_extract(experiment, {_FORM}, 3) AS INTEGER) AS x, count(*) AS n FROM train WHERE experiment IS NOT NULL GROUP BY 1, 2, 3)
 SELECT c.year, c.x, c.backend, coalesce(CAST(n.n AS VARCHAR), 'MISSING') AS n_rows FROM cells c LEFT JOIN n USING (year, x, backend)""")
def benchmark_table(spark: SparkSession, d: str) -> DataFrame:
    form = _FORM.strip("'")
    year, backend, x = (F.regexp_extract("experiment", form, k) for k in (1, 2, 3))
    counts = table(spark, d, "train").where("experiment IS NOT NULL").groupBy("experiment").agg(F.count("*").alias("n"))
    held = counts.groupBy(year.try_cast("int").alias("year"), backend.alias("backend"), x.try_cast("int").alias("x")).agg(F.sum("n").alias("n"))
    return _cells(spark, d).join(held, ["year", "x", "backend"], "left").select("year", "x", "backend", F.coalesce(F.col("n").cast("string"), F.lit("MISSING")).alias("n_rows"))


@query(r"""SELECT experiment, CASE WHEN contains(lower(experiment), 'base') THEN 1930 ELSE TRY_CAST(nullif(regexp_extract(experiment, '(\d{4})', 1), '') AS INTEGER) END AS year, replace(regexp_replace(experiment, '^policy_\d{4}_', ''), '_', ' ') AS label FROM (SELECT DISTINCT experiment FROM train WHERE experiment IS NOT NULL)""")
def experiment_labels(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "train").where("experiment IS NOT NULL").select("experiment").distinct()
    year = F.when(F.lower("experiment").contains("base"), 1930).otherwise(F.regexp_extract("experiment", r"(\d{4})", 1).try_cast("int"))
    return named.select("experiment", year.alias("year"), F.replace(F.regexp_replace("experiment", r"^policy_\d{4}_", ""), F.lit("_"), F.lit(" ")).alias("label"))


@query(r"""SELECT backend, max(x) AS largest FROM (SELECT regexp_extract(experiment, '^policy_\d{4}_([a-z]+)_', 1) AS backend, TRY_CAST(regexp_extract(experiment, '_n(\d+)', 1) AS INTEGER) AS x FROM train WHERE experiment IS NOT NULL) WHERE x IS NOT NULL GROUP BY backend""")
def largest_tag(spark: SparkSession, d: str) -> DataFrame:
    tag = table(spark, d, "train").select(F.regexp_extract("experiment", r"^policy_\d{4}_([a-z]+)_", 1).alias("backend"), F.regexp_extract("experiment", r"_n(\d+)", 1).try_cast("int").alias("x"))
    return tag.where("x IS NOT NULL").groupBy("backend").agg(F.max("x").alias("largest"))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS INTEGER) AS k FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) WHERE p_name[i] = 'e'")
def running_letters(spark: SparkSession, d: str) -> DataFrame:
    """Places of a letter in a word with their running count."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("p_name"), F.lit(1))), lambda i: F.substring(F.col("p_name"), i, F.lit(1)) == "e")
    return table(spark, d, "part").select("p_partkey", F.posexplode(at).alias("k", "pos")).select("p_partkey", "pos", (F.col("k") + 1).alias("k"))


@query("SELECT source, b AS batch, least(100, n - b * 100) AS size FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), LATERAL (SELECT unnest(range(0, (n + 99) // 100)) AS b)")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    each = counts.withColumn("batch", F.explode(F.expr("sequence(0L, (n + 99) DIV 100 - 1)")))
    return each.select("source", "batch", F.least(F.lit(100).cast("long"), F.col("n") - F.col("batch") * 100).alias("size"))


_STAGE = "CASE split_part(source, ':', 1) WHEN 'newswire' THEN 0 WHEN 'weekly' THEN 1 WHEN 'gst' THEN 2 ELSE 3 END"


@query(f"SELECT doc_id, {_STAGE} AS stage, row_number() OVER (ORDER BY {_STAGE}, doc_id) - 1 AS pos FROM documents")
def curriculum_order(spark: SparkSession, d: str) -> DataFrame:
    """Stages one after the other, each in the order of its ids."""
    prefix = F.substring_index("source", ":", 1)
    stage = F.when(prefix == "newswire", 0).when(prefix == "weekly", 1).when(prefix == "gst", 2).otherwise(3)
    rows = table(spark, d, "documents").select("doc_id", stage.alias("stage")).withColumn("at", F.struct("stage", "doc_id")).withColumn("one", F.lit(1))
    return C.running_start(rows, "at", "one", "pos").select("doc_id", "stage", "pos")


@query("SELECT event_id, benchmark_question FROM battery WHERE trim(benchmark_question) <> '' AND lower(benchmark_question) <> 'nan'")
def asked_policies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "battery").where((F.trim("benchmark_question") != "") & (F.lower("benchmark_question") != "nan")).select("event_id", "benchmark_question")
