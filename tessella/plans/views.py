"""Inputs of the query catalogue: questions, votes, captions, scores and tracks made from the base tables.

Each view is given twice, as a DataFrame and as SQL, so that a query and its
SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (scope, question, four options)
BANK = (
    ("environment", "What is the weather in the scene?", "sunny", "cloudy", "rainy", "clear"),
    ("environment", "What is the brightness of the scene?", "bright", "dim", "dark", "glare"),
    ("environment", "What are the road surface conditions?", "dry", "wet", "icy", "muddy"),
    ("environment", "What is the road inclination?", "level", "gentle slope", "steep slope", "unknown"),
    ("environment", "Is there an obstacle on the street?", "no", "yes", "partly", "unknown"),
    ("environment", "What is the age group of the pedestrian?", "10s", "20s", "30s", "60s"),
    ("environment", "Is the person wearing a hat?", "no", "yes", "a helmet", "a hood"),
    ("environment", "What is the pedestrian wearing on upper body?", "t-shirt", "jacket", "shirt", "coat"),
    ("environment", "What is the color of the upper body clothing?", "black", "white", "blue", "grey"),
    ("environment", "What is the volume of the traffic?", "light", "usual", "heavy", "none"),
    ("environment", "How many lanes are there?", "one lane", "two lanes", "three lanes", "four lanes"),
    ("environment", "What is the time of year?", "spring", "summer", "autumn", "winter"),
    ("vehicle_view", "Is the pedestrian in the vehicle's field of view?", "yes", "no", "partly", "unknown"),
    ("vehicle_view", "What is the action taken by vehicle?", "going straight", "turning left", "turning right", "stopped"),
    ("vehicle_view", "What is the position of the vehicle relative to the pedestrian?", "in front", "behind", "left", "right"),
    ("vehicle_view", "What is the relative distance of vehicle from pedestrian?", "near", "far", "adjacent", "unknown"),
    ("vehicle_view", "What is the vehicle's speed?", "0 km/h", "5 km/h", "10 km/h", "30 km/h"),
    ("overhead_view", "What is the orientation of the pedestrian's body?", "same direction", "opposite direction", "perpendicular", "diagonal"),
    ("overhead_view", "What is the position of the pedestrian relative to the vehicle?", "in front", "behind", "left", "right"),
    ("overhead_view", "What is the relative distance of pedestrian from vehicle?", "near", "far", "adjacent", "unknown"),
    ("overhead_view", "What is the pedestrian's line of sight?", "the vehicle", "the ground", "ahead", "a phone"),
    ("overhead_view", "What is the pedestrian's visual status?", "looking", "closely watching", "not looking", "unknown"),
    ("overhead_view", "What is the pedestrian's direction of travel?", "along the road", "across the road", "standing", "unknown"),
    ("overhead_view", "What is the pedestrian's awareness of the vehicle?", "aware", "unaware", "notices late", "unknown"),
    ("overhead_view", "What is the pedestrian's speed?", "standing", "walking", "running", "unknown"),
    ("overhead_view", "What is the pedestrian's action?", "crossing", "waiting", "turning back", "entering"),
    ("overhead_view", "What is the fine-grained action taken by the pedestrian?", "walking", "jogging", "waving", "falling"),
    ("overhead_view", "What does the camera show next?", "a street", "a shop", "a park", "nothing"),
)
N = len(BANK)
SOURCES = ("env", "joint", "qwen35", "visual", "vehicle", "ped_dynamic", "geometry")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, letters: str = "abcd") -> Column:
    """The letter at number modulo their count."""
    return F.substring(F.lit(letters), (F.pmod(number, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ord, scenario_id, scope, phase, question, options, correct``: one for each order."""
    bank = spark.createDataFrame([(k, *row) for k, row in enumerate(BANK)], "k long, scope string, question string, oa string, ob string, oc string, od string")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(bank), F.expr(f"o_orderkey % {N} = k"))
    options = F.map_from_arrays(F.array(*map(F.lit, "abcd")), F.array("oa", "ob", "oc", "od"))
    return rows.select(
        F.concat(F.lit("q"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), F.expr("o_custkey % 50")).alias("scenario_id"), "scope",
        F.when(F.col("scope") != "environment", F.expr("cast(o_orderkey % 5 as string)")).alias("phase"), "question", options.alias("options"), pick(F.expr(f"o_orderkey div {N}")).alias("correct"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ord, letter``: mostly one answer for a scenario's question."""
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("q"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"),
        F.when(F.expr(f"o_orderkey div {N} % 7 < 6"), pick(F.expr(f"o_custkey % 50 + o_orderkey % {N}"))).otherwise(pick(F.col("o_orderkey"))).alias("letter"),
    )


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ord, letter`` of the fallback."""
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), pick(F.col("o_custkey")).alias("letter"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, letter``: a source's vote is its line of the order."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    names = F.get(F.array(*map(F.lit, SOURCES)), F.expr("cast((l_linenumber - 1) % 7 as int)"))
    return lines.select(F.concat(F.lit("q"), "l_orderkey").alias("id"), names.alias("source"), pick(F.col("p")).alias("letter"))


def scores(spark: SparkSession, sf_dir: str, first: int = 0) -> DataFrame:
    """``id, letter, score``: four components of a vector, rounded so that scores tie."""
    entries = F.array(*(F.struct(F.lit(x).alias("letter"), (F.round(F.col("embedding")[first + i].cast("double"), 1) + 0.0).alias("score")) for i, x in enumerate("abcd")))
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.explode(entries).alias("e")).select("id", "e.letter", "e.score")


def score_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), pick(F.col("label")).alias("correct"), "label", "vec_id")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``role, track, phase, image_id, ord, x, y, w, h``: events of a user as frames of a track."""
    rows = read(spark, sf_dir, "events")
    return rows.select(
        F.when(F.col("event_type").isin("click", "view"), "pedestrian").otherwise("vehicle").alias("role"), F.col("user_id").alias("track"), F.expr("cast(event_id % 5 as string)").alias("phase"),
        F.expr("event_id * 7 % 4001").alias("image_id"), F.col("event_id").alias("ord"), F.expr("cast(event_id * 13 % 1900 as double)").alias("x"), F.expr("event_id * 29 % 2000 / 2.0").alias("y"),
        F.expr("cast(event_id % 300 as double)").alias("w"), F.expr("event_id % 251 + 0.5").cast("double").alias("h"),
    )


def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair, candidate, reference``: documents that follow each other; two of three candidates go on with the next document's text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    mixed = F.when(F.expr("doc_id % 3 = 0"), F.col("text")).otherwise(F.concat_ws(" ", "text", "next"))
    return docs.join(after, "doc_id").select(F.col("doc_id").alias("pair"), mixed.alias("candidate"), F.col("text").alias("reference"))


def neighbour_pairs(spark: SparkSession, sf_dir: str, bits: int = 10) -> DataFrame:
    """``near, pair, candidate, reference``: as caption_pairs, in runs of 2**bits documents, so that each text is exchanged once."""
    docs = read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    ends = F.array_distinct(F.array(*(F.shiftright(F.col("doc_id") - k, bits) for k in (0, 1))))
    dealt = docs.select(F.explode(ends).alias("near"), "doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "near")
    # all rows of the next number, as a join has them
    after = F.collect_list(F.struct(F.col("text").alias("next"))).over(Window.partitionBy("near").orderBy("doc_id").rangeBetween(1, 1))
    met = dealt.withColumn("_after", after).where(F.shiftright("doc_id", bits) == F.col("near")).select("near", "doc_id", "text", F.inline("_after"))
    mixed = F.when(F.expr("doc_id % 3 = 0"), F.col("text")).otherwise(F.concat_ws(" ", "text", "next"))
    return met.select("near", F.col("doc_id").alias("pair"), mixed.alias("candidate"), F.col("text").alias("reference"))


def copies(rows: DataFrame, n: int) -> DataFrame:
    """Each row n times, with ``copy`` from 0 to n - 1.

    A small column of keys becomes a large table here.  The rows are dealt out
    before, else they are made by the few tasks that read the file.  And they
    meet a range, since an explode would leave the planner with the size of the
    keys, so that it would send the table to the driver to broadcast it.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *rows.columns)
    return dealt.crossJoin(F.broadcast(spark.range(n, numPartitions=1).withColumnRenamed("id", "copy")))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, scenario_id, row_idx, phase, caption_pedestrian, caption_vehicle``: three sources for each of some customers and phases, faulty by turns."""
    source = F.get(F.array(*map(F.lit, ("base", "fused", "slots"))), F.expr("cast(copy % 3 as int)"))
    base = copies(read(spark, sf_dir, "customer").select("c_custkey"), 15).select("c_custkey", F.expr("cast(copy div 3 as int)").alias("row_idx"), source.alias("source"))
    n = F.expr("c_custkey * 5 + row_idx + case source when 'base' then 0 when 'fused' then 3 else 7 end")
    ages, colours = F.array(*map(F.lit, ("10s", "20s", "30s", "60s"))), F.array(*map(F.lit, ("black", "white", "blue", "gray")))
    age, colour = F.get(ages, F.pmod(n, F.lit(4)).cast("int")), F.get(colours, F.pmod(F.floor(n / 2), F.lit(4)).cast("int"))
    p = F.concat(F.lit("The pedestrian was a male in his "), age, F.lit(" wearing a "), colour, F.lit(" jacket. He was standing near the vehicle on a dry asphalt road"))
    p = F.concat(p, F.when(F.pmod(n, F.lit(6)) == 0, F.lit(" and")).when(F.pmod(n, F.lit(6)) == 1, F.lit(" in front of the")).otherwise(F.lit(" and noticed the vehicle.")))
    v = F.concat(F.lit("The vehicle was moving at "), F.pmod(n, F.lit(4)).cast("string"), F.lit("0 km/h. The weather was cloudy. "), F.when(F.pmod(n, F.lit(5)) == 0, F.lit("It stopped. It stopped. It stopped.")).otherwise(F.lit("The road was level with light traffic.")))
    v = F.concat(v, F.when(F.pmod(n, F.lit(11)) == 0, F.lit(" Return JSON.")).otherwise(F.lit("")))
    return base.select("source", F.concat(F.lit("s"), "c_custkey").alias("scenario_id"), "row_idx", F.col("row_idx").cast("string").alias("phase"), p.alias("caption_pedestrian"), v.alias("caption_vehicle"))


def caption_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario_id, phase, key, value``: age and colour for a scenario, speed for each phase."""
    rows = copies(read(spark, sf_dir, "customer").select("c_custkey"), 7)
    ages, colours = F.array(*map(F.lit, ("10s", "20s", "30s", "60s"))), F.array(*map(F.lit, ("black", "white", "blue", "grey")))
    k = F.col("c_custkey")
    own = F.array(
        F.struct(F.lit(None).cast("string").alias("phase"), F.lit("pedestrian.age_group").alias("key"), F.get(ages, F.pmod(k, F.lit(4)).cast("int")).alias("value")),
        F.struct(F.lit(None).cast("string").alias("phase"), F.lit("pedestrian.upper_body_color").alias("key"), F.get(colours, F.pmod(k, F.lit(4)).cast("int")).alias("value")),
        *(F.struct(F.lit(str(p)).alias("phase"), F.lit("vehicle.speed").alias("key"), F.concat(F.pmod(k + p, F.lit(4)).cast("string"), F.lit("0 km/h")).alias("value")) for p in range(5)),
    )
    return rows.select(F.concat(F.lit("s"), "c_custkey").alias("scenario_id"), F.get(own, F.col("copy").cast("int")).alias("f")).select("scenario_id", "f.*")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BANK_SQL = "bank(k, scope, question, oa, ob, oc, od) AS (VALUES " + ", ".join(f"({k}, {', '.join(map(_quote, row))})" for k, row in enumerate(BANK)) + ")"
QUESTIONS_SQL = f"""{BANK_SQL},
q AS (
  SELECT 'q' || o_orderkey AS id, o_orderkey AS ord, 's' || (o_custkey % 50) AS scenario_id, scope, CASE WHEN scope <> 'environment' THEN (o_orderkey % 5)::VARCHAR END AS phase,
         question, [oa, ob, oc, od] AS options, substr('abcd', 1 + ((o_orderkey // {N}) % 4)::INT, 1) AS correct, o_custkey, k
  FROM orders JOIN bank ON k = o_orderkey % {N})"""
ANSWERS_SQL = f"""a AS (
  SELECT 'q' || o_orderkey AS id, o_orderkey AS ord,
         CASE WHEN o_orderkey // {N} % 7 < 6 THEN substr('abcd', 1 + ((o_custkey % 50 + o_orderkey % {N}) % 4)::INT, 1) ELSE substr('abcd', 1 + (o_orderkey % 4)::INT, 1) END AS letter
  FROM orders)"""
FALLBACK_SQL = "f AS (SELECT 'q' || o_orderkey AS id, o_orderkey AS ord, substr('abcd', 1 + (o_custkey % 4)::INT, 1) AS letter FROM orders)"
VOTES_SQL = f"""v AS (
  SELECT 'q' || l_orderkey AS id, [{', '.join(map(_quote, SOURCES))}][((l_linenumber - 1) % 7 + 1)::INT] AS source, substr('abcd', 1 + (max(l_partkey) % 4)::INT, 1) AS letter
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def scores_sql(name: str, first: int = 0) -> str:
    return f"{name} AS (SELECT 'v' || vec_id AS id, unnest(['a', 'b', 'c', 'd']) AS letter, unnest(list_transform(embedding[{first + 1}:{first + 4}], lambda x: round(x::DOUBLE, 1) + 0.0)) AS score FROM embeddings)"


CORRECT_SQL = "c AS (SELECT 'v' || vec_id AS id, substr('abcd', 1 + label % 4, 1) AS correct, label, vec_id FROM embeddings)"
TRACKS_SQL = """t AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'pedestrian' ELSE 'vehicle' END AS role, user_id AS track, (event_id % 5)::VARCHAR AS phase, event_id * 7 % 4001 AS image_id, event_id AS ord,
         (event_id * 13 % 1900)::DOUBLE AS x, (event_id * 29 % 2000) / 2.0::DOUBLE AS y, (event_id % 300)::DOUBLE AS w, (event_id % 251 + 0.5)::DOUBLE AS h
  FROM events)"""
PAIRS_SQL = """pr AS (
  SELECT d.doc_id AS pair, CASE WHEN d.doc_id % 3 = 0 THEN d.text ELSE concat_ws(' ', d.text, n.text) END AS candidate, d.text AS reference
  FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"""
CAPTIONS_SQL = """cap0 AS (
  SELECT source, 's' || c_custkey AS scenario_id, row_idx, row_idx::VARCHAR AS phase, c_custkey * 5 + row_idx + CASE source WHEN 'base' THEN 0 WHEN 'fused' THEN 3 ELSE 7 END AS n
  FROM customer, (SELECT unnest(range(5))::INT AS row_idx), (SELECT unnest(['base', 'fused', 'slots']) AS source)),
cap AS (
  SELECT source, scenario_id, row_idx, phase,
    'The pedestrian was a male in his ' || ['10s', '20s', '30s', '60s'][(n % 4 + 1)::INT] || ' wearing a ' || ['black', 'white', 'blue', 'gray'][((n // 2) % 4 + 1)::INT] || ' jacket. He was standing near the vehicle on a dry asphalt road'
      || CASE n % 6 WHEN 0 THEN ' and' WHEN 1 THEN ' in front of the' ELSE ' and noticed the vehicle.' END AS caption_pedestrian,
    'The vehicle was moving at ' || (n % 4) || '0 km/h. The weather was cloudy. ' || CASE WHEN n % 5 = 0 THEN 'It stopped. It stopped. It stopped.' ELSE 'The road was level with light traffic.' END
      || CASE WHEN n % 11 = 0 THEN ' Return JSON.' ELSE '' END AS caption_vehicle
  FROM cap0)"""
FACTS_SQL = """fact AS (
  SELECT 's' || c_custkey AS scenario_id, NULL::VARCHAR AS phase, 'pedestrian.age_group' AS key, ['10s', '20s', '30s', '60s'][(c_custkey % 4 + 1)::INT] AS value FROM customer
  UNION ALL SELECT 's' || c_custkey, NULL, 'pedestrian.upper_body_color', ['black', 'white', 'blue', 'grey'][(c_custkey % 4 + 1)::INT] FROM customer
  UNION ALL SELECT 's' || c_custkey, p::VARCHAR, 'vehicle.speed', ((c_custkey + p) % 4) || '0 km/h' FROM customer, (SELECT unnest(range(5)) AS p))"""
