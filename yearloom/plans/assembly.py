"""Recency-weighted pools, samples and work lists. Lens: synth records of a year are its pool, train years are models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearloom.operators import joins as J
from yearloom.operators import selection as S
from yearloom.operators import windowing as W
from yearloom.plans.registry import query
from yearloom.session import table

_POOLS = """rec AS (SELECT DISTINCT metadata.year AS year, synth_id FROM synth WHERE metadata.year IS NOT NULL),
pools AS (SELECT year AS source_year, count(*) AS n FROM rec GROUP BY year),
models AS (SELECT DISTINCT year AS model_year FROM train WHERE year IS NOT NULL),
pairs AS (SELECT model_year, source_year FROM models JOIN pools ON source_year <= model_year),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_year ORDER BY source_year DESC) AS k FROM pairs)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "synth").select(F.col("metadata.year").alias("year"), "synth_id").where("year IS NOT NULL").distinct()


def _models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").where("year IS NOT NULL").select(F.col("year").alias("model_year")).distinct()


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy(F.col("year").alias("source_year")).agg(F.count("*").alias("n"))


def _weights(spark: SparkSession, d: str, spec: str) -> DataFrame:
    return W.year_weights(_models(spark, d), _sizes(spark, d), W.parse_spec(spec))


def _rounded(weights: DataFrame) -> DataFrame:
    return weights.select("model_year", "source_year", F.round("weight", 6).alias("weight"))


_ROLL = f"{_POOLS}, weights AS (SELECT model_year, source_year, 1.0 / count(*) OVER (PARTITION BY model_year) AS weight FROM ranked WHERE k <= 10)"
_EXP = f"{_POOLS}, raw AS (SELECT *, pow(0.5, (model_year - source_year) / 5.0) AS w FROM pairs), weights AS (SELECT model_year, source_year, w / sum(w) OVER (PARTITION BY model_year) AS weight FROM raw)"


@query(f"WITH {_ROLL} SELECT model_year, source_year, round(CAST(weight AS DOUBLE), 6) AS weight FROM weights")
def year_weights_roll(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_weights(spark, d, "roll10"))


@query(f"WITH {_EXP} SELECT model_year, source_year, round(weight, 6) AS weight FROM weights")
def year_weights_exp(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_weights(spark, d, "exp5"))


@query(f"WITH {_POOLS} SELECT model_year, source_year, round(CAST(1.0 / count(*) OVER (PARTITION BY model_year) AS DOUBLE), 6) AS weight FROM pairs")
def year_weights_cum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_weights(spark, d, "cum"))


@query(f"WITH {_POOLS} SELECT model_year, max(source_year) AS source_year, CAST(1.0 AS DOUBLE) AS weight FROM pairs GROUP BY model_year")
def year_weights_single(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_weights(spark, d, "single"))


def _allocated(weights: str, budget: str) -> str:
    return f"""{weights}, ex AS (SELECT *, {budget} AS budget, round(weight * {budget}, 9) AS exact FROM weights),
fl AS (SELECT *, floor(exact) AS f, budget - sum(floor(exact)) OVER (PARTITION BY model_year) AS leftover, row_number() OVER (PARTITION BY model_year ORDER BY exact - floor(exact) DESC, source_year DESC) AS place FROM ex),
counts AS (SELECT f.model_year, f.source_year, CAST(f + CASE WHEN place <= leftover THEN 1 ELSE 0 END AS BIGINT) AS wanted, CAST(least(f + CASE WHEN place <= leftover THEN 1 ELSE 0 END, n) AS BIGINT) AS n_rows FROM fl f JOIN pools p ON p.source_year = f.source_year)"""


@query(f"WITH {_allocated(_EXP, '1000')} SELECT * FROM counts")
def allocate_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.allocate(_weights(spark, d, "exp5"), _sizes(spark, d), total=1000).drop("weight")


@query(f"WITH {_allocated(_ROLL, 'count(*) OVER (PARTITION BY model_year) * 60')} SELECT * FROM counts")
def allocate_counts_clipped(spark: SparkSession, d: str) -> DataFrame:
    return W.allocate(_weights(spark, d, "roll10"), _sizes(spark, d), per_year=60).drop("weight")


_ORDER = f"{_POOLS}, ord AS (SELECT year, synth_id, row_number() OVER (PARTITION BY year ORDER BY md5('0:' || year || ':' || synth_id), synth_id) - 1 AS pos FROM rec)"
_POOL = f"""{_ORDER}, size AS (SELECT year, count(*) AS n FROM ord GROUP BY year),
extra AS (SELECT year, n, unnest(range(n, 40)) AS pos FROM size WHERE n < 40),
pool AS (SELECT year, pos, synth_id, false AS resampled FROM ord WHERE pos < 40 UNION ALL
 SELECT e.year, e.pos, o.synth_id, true FROM extra e JOIN ord o ON o.year = e.year AND o.pos = CAST('0x' || substr(md5('0:draw:' || e.year || ':' || e.pos), 1, 8) AS BIGINT) % e.n)"""


@query(f"WITH {_ORDER} SELECT * FROM ord")
def stable_order(spark: SparkSession, d: str) -> DataFrame:
    return W.stable_order(_records(spark, d), "year", "synth_id").select("year", "synth_id", "pos")


@query(f"WITH {_ORDER}, lv(level) AS (VALUES (5), (10), (20)) SELECT level, year, count(*) AS n, sum(synth_id)::BIGINT AS id_sum FROM ord JOIN lv ON pos < level GROUP BY 1, 2")
def nested_prefix(spark: SparkSession, d: str) -> DataFrame:
    ordered = W.stable_order(_records(spark, d), "year", "synth_id")
    levels = F.filter(F.array(*[F.lit(x) for x in (5, 10, 20)]), lambda x: F.col("pos") < x)
    return ordered.where("pos < 20").select("year", "synth_id", F.explode(levels).alias("level")).groupBy("level", "year").agg(F.count("*").alias("n"), F.sum("synth_id").alias("id_sum"))


@query(f"WITH {_POOL} SELECT * FROM pool")
def build_pool(spark: SparkSession, d: str) -> DataFrame:
    return W.build_pool(_records(spark, d), "year", "synth_id", 40)


@query(f"WITH {_POOL} SELECT year, count(*) FILTER (NOT resampled) AS n_distinct, count(*) AS n_total, count(*) FILTER (resampled) AS n_resampled, 40::BIGINT AS target FROM pool GROUP BY year")
def pool_manifest(spark: SparkSession, d: str) -> DataFrame:
    return W.pool_manifest(W.build_pool(_records(spark, d), "year", "synth_id", 40), "year", 40)


_ASSEMBLED = f"""{_POOL}, {_allocated(_ROLL, '100').replace(_POOLS + ', ', '')},
picked AS (SELECT c.model_year, p.year AS source_year, p.pos AS source_pos, synth_id FROM pool p JOIN counts c ON c.source_year = p.year AND p.pos < c.n_rows),
assembled AS (SELECT *, row_number() OVER (PARTITION BY model_year ORDER BY md5('0:' || model_year || ':' || source_year || ':' || source_pos), source_year, source_pos) - 1 AS pos FROM picked)"""


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    pool = W.build_pool(_records(spark, d), "year", "synth_id", 40)
    return W.assemble(pool, W.allocate(_weights(spark, d, "roll10"), _sizes(spark, d), total=100), "year", "synth_id")


@query(f"WITH {_ASSEMBLED} SELECT * FROM assembled")
def assemble_window(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)


@query(f"""WITH {_ASSEMBLED}, man AS (SELECT year, count(*) FILTER (NOT resampled) AS n_distinct FROM pool GROUP BY year)
 SELECT a.model_year, a.source_year, count(*) AS n, least(count(*), any_value(n_distinct)) AS effective_unique, round(CAST(any_value(weight) AS DOUBLE), 6) AS weight
 FROM assembled a JOIN man ON man.year = a.source_year JOIN weights w ON w.model_year = a.model_year AND w.source_year = a.source_year GROUP BY 1, 2""")
def assemble_manifest(spark: SparkSession, d: str) -> DataFrame:
    manifest = W.pool_manifest(W.build_pool(_records(spark, d), "year", "synth_id", 40), "year", 40)
    return W.assembly_manifest(_assembled(spark, d), manifest, _weights(spark, d, "roll10"), "year")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 25")
def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return S.first_per_group(docs, ["source"], [S.hash_order("42", F.col("doc_id")), F.col("doc_id")], 25)


@query("""SELECT doc_id, year, source FROM (SELECT doc_id, year, source, row_number() OVER (PARTITION BY year ORDER BY CASE WHEN source LIKE 'fomc:%' THEN 0 ELSE 1 END, md5('42:' || doc_id), doc_id) AS k
 FROM documents WHERE year IS NOT NULL AND (source LIKE 'fomc:%' OR source LIKE 'weekly:%')) WHERE k <= 8""")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "year", "source").where("year IS NOT NULL AND (source LIKE 'fomc:%' OR source LIKE 'weekly:%')")
    return S.quota_fill(docs, ["year"], F.when(F.col("source").startswith("fomc:"), 0).otherwise(1), [S.hash_order("42", F.col("doc_id")), F.col("doc_id")], 8)


@query("""WITH m AS (SELECT DISTINCT msg_id, target_label FROM run WHERE target_label IN ('Yes', 'No') AND lower(trim(role)) = 'assistant'),
 r AS (SELECT *, row_number() OVER (PARTITION BY target_label ORDER BY msg_id) AS k FROM m) SELECT msg_id, target_label FROM r WHERE k <= CASE target_label WHEN 'Yes' THEN 51 ELSE 50 END""")
def label_trim(spark: SparkSession, d: str) -> DataFrame:
    want = S.even_split(101, ["Yes", "No"])
    rows = table(spark, d, "run").where((F.lower(F.trim("role")) == "assistant") & F.col("target_label").isin(list(want))).select("msg_id", "target_label").distinct()
    most = F.when(F.col("target_label") == "Yes", want["Yes"]).otherwise(want["No"])
    return S.first_per_group(rows, ["target_label"], [F.col("msg_id")], most, max(want.values()))


@query("SELECT target_label, count(DISTINCT msg_id) AS n FROM run WHERE lower(trim(role)) = 'assistant' GROUP BY target_label")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run").where(F.lower(F.trim("role")) == "assistant").groupBy("target_label").agg(F.count_distinct("msg_id").alias("n"))


@query("""SELECT item_id, shot, place FROM (SELECT a.item_id, b.item_id AS shot, row_number() OVER (PARTITION BY a.item_id ORDER BY md5('1234:' || a.item_id || ':' || b.item_id), b.item_id) AS place
 FROM heldout a JOIN heldout b ON split_part(a.item_id, '-', 1) = split_part(b.item_id, '-', 1) AND a.item_id <> b.item_id WHERE b.expected IS NOT NULL) WHERE place <= 5""")
def fewshot(spark: SparkSession, d: str) -> DataFrame:
    """Five other items of the same suite for each item; the suites are fixed lists of a few hundred items."""
    items = table(spark, d, "heldout").select("item_id", F.substring_index("item_id", "-", 1).alias("suite"), "expected")
    shots = items.where("expected IS NOT NULL").select("suite", F.col("item_id").alias("shot"))
    pairs = items.select("item_id", "suite").join(shots, "suite").where("item_id <> shot")
    order = Window.partitionBy("item_id").orderBy(S.hash_order("1234", F.col("item_id"), F.col("shot")), "shot")
    return pairs.withColumn("place", F.row_number().over(order)).where("place <= 5").select("item_id", "shot", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT 'battery' AS task, event_id AS key, unnest(range(0, 2)) AS copy FROM battery UNION ALL SELECT 'heldout', item_id, 0 FROM heldout)
 SELECT task, key, copy::INTEGER AS copy, row_number() OVER (ORDER BY md5('42:' || task || ':' || key || ':' || copy), task, key, copy) - 1 AS pos FROM m""")
def interleave_tasks(spark: SparkSession, d: str) -> DataFrame:
    mixed = S.interleaved({"battery": table(spark, d, "battery").withColumnRenamed("event_id", "item_id"), "heldout": table(spark, d, "heldout")}, {"battery": 2}, "item_id", "42")
    order = Window.orderBy("shuffle_key", "task", "key", "copy")  # both tables are fixed and small
    return mixed.select("task", "key", "copy", (F.row_number().over(order) - 1).cast("long").alias("pos"))


@query(f"WITH {_ORDER} SELECT year, synth_id, pos FROM ord WHERE pos >= 3 AND pos < 31 AND (pos - 3) % 4 = 0")
def stride_slice(spark: SparkSession, d: str) -> DataFrame:
    return S.stride(W.stable_order(_records(spark, d), "year", "synth_id"), "pos", 3, 31, 4).select("year", "synth_id", "pos")


_CELLS = """cells AS (SELECT y.year, l.x, b.backend FROM (SELECT DISTINCT year FROM train WHERE year IS NOT NULL) y, (VALUES (5000), (10000), (20000), (40000)) l(x), (VALUES ('nanochat'), ('talkie')) b(backend)),
done AS (SELECT DISTINCT TRY_CAST(regexp_extract(experiment, '^policy_(\\d{4})_([a-z]+)_.*_n(\\d+)', 1) AS INTEGER) AS year, regexp_extract(experiment, '^policy_(\\d{4})_([a-z]+)_.*_n(\\d+)', 2) AS backend,
 TRY_CAST(regexp_extract(experiment, '^policy_(\\d{4})_([a-z]+)_.*_n(\\d+)', 3) AS INTEGER) AS x FROM train WHERE experiment IS NOT NULL)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "train").where("year IS NOT NULL").select("year").distinct()
    backends, levels = F.array(F.lit("nanochat"), F.lit("talkie")), F.array(*[F.lit(x) for x in (5000, 10000, 20000, 40000)])
    return years.withColumn("x", F.explode(levels)).withColumn("backend", F.explode(backends))


def _done(spark: SparkSession, d: str) -> DataFrame:
    form = r"^policy_(\d{4})_([a-z]+)_.*_n(\d+)"
    part = [F.regexp_extract("experiment", form, k) for k in (1, 2, 3)]
    return table(spark, d, "train").where("experiment IS NOT NULL").select("experiment").distinct().select(part[0].try_cast("int").alias("year"), part[1].alias("backend"), part[2].try_cast("int").alias("x")).distinct()


@query(f"WITH {_CELLS} SELECT * FROM cells")
def matrix_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"WITH {_CELLS} SELECT * FROM cells ANTI JOIN done USING (year, x, backend)")
def cells_pending(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).join(_done(spark, d), ["year", "x", "backend"], "left_anti")


@query(f"WITH {_CELLS}, data AS (SELECT DISTINCT metadata.year AS year FROM synth) SELECT * FROM cells ANTI JOIN done USING (year, x, backend) SEMI JOIN data USING (year)")
def cells_ready(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "synth").select(F.col("metadata.year").alias("year")).distinct()
    return _cells(spark, d).join(_done(spark, d), ["year", "x", "backend"], "left_anti").join(data, "year", "left_semi")


@query(f"""WITH {_CELLS}, c AS (SELECT c.*, d.year IS NOT NULL AS ok FROM cells c LEFT JOIN done d USING (year, x, backend)),
 r AS (SELECT *, bool_and(ok) OVER (PARTITION BY x, backend ORDER BY year ROWS UNBOUNDED PRECEDING) AS so_far FROM c) SELECT year, x, backend FROM r WHERE so_far""")
def chain_prefix(spark: SparkSession, d: str) -> DataFrame:
    marked = _cells(spark, d).join(_done(spark, d).withColumn("ok", F.lit(True)), ["year", "x", "backend"], "left")
    return J.unbroken_chain(marked, ["x", "backend"], "year", F.coalesce("ok", F.lit(False))).select("year", "x", "backend")


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i FROM battery), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM heldout) SELECT event_id, item_id FROM a JOIN b USING (i)""")
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    return J.zipped(table(spark, d, "battery").select("event_id"), table(spark, d, "heldout").select("item_id"), "event_id", "item_id")


@query("""SELECT o_orderkey, o_custkey, ts AS ts, value FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 9000 DAY AS at FROM orders) o
 ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2) e ON o.o_custkey = e.user_id AND o.at >= e.ts""")
def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderdate + INTERVAL 9000 DAY").alias("at"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("o_custkey"), "ts").agg(F.max("value").alias("value"))
    return J.as_of(orders, events, ["o_custkey"], "at", "ts", "value").select("o_orderkey", "o_custkey", "ts", "value")


@query("SELECT DISTINCT year FROM (SELECT year FROM train UNION ALL SELECT metadata.year FROM synth UNION ALL SELECT year FROM run) WHERE year IS NOT NULL")
def year_set(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "train").select("year").unionByName(table(spark, d, "synth").select(F.col("metadata.year").alias("year"))).unionByName(table(spark, d, "run").select("year"))
    return years.where("year IS NOT NULL").distinct()


@query("""SELECT experiment, row_number() OVER (ORDER BY CASE WHEN experiment = 'base' THEN 0 ELSE 1 END, coalesce(TRY_CAST(regexp_extract(experiment, '(\\d{4})', 1) AS INTEGER), 0), experiment) AS place FROM (SELECT DISTINCT experiment FROM train WHERE experiment IS NOT NULL)""")
def label_sort(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "train").where("experiment IS NOT NULL").select("experiment").distinct()
    number = F.coalesce(F.regexp_extract("experiment", r"(\d{4})", 1).try_cast("int"), F.lit(0))
    return names.select("experiment", F.row_number().over(Window.orderBy(F.when(F.col("experiment") == "base", 0).otherwise(1), number, "experiment")).cast("long").alias("place"))
