"""Profile queries: the star schema and the documents stand in for a repository's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import metadata as M
from corpuslens.operators import profile as P
from corpuslens.registry import query
from corpuslens.tables import table


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS most FROM documents GROUP BY lang")
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return P.describe(table(spark, d, "documents"), "n_chars", ["lang"]).withColumns({c: F.round(c, 6) for c in ("mean", "p95")})


@query("WITH b AS (SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1), s AS (SELECT unnest(range(min(bin), max(bin) + 1, 500)) AS bin FROM b) SELECT bin, coalesce(n, 0) AS n FROM s LEFT JOIN b USING (bin)")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram(table(spark, d, "documents"), "n_chars", 500)


CAL = "WITH o AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), y AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM o), g AS (SELECT * FROM (SELECT DISTINCT status FROM o), y)"


@query(
    CAL
    + """, a AS (SELECT status, CAST(g.year AS INTEGER) AS year, count(o.year) AS n, 0 AS level FROM g LEFT JOIN o USING (status, year) GROUP BY status, g.year UNION ALL SELECT status, NULL, count(*), 1 FROM o GROUP BY status UNION ALL SELECT NULL, year, count(*), 2 FROM o GROUP BY year UNION ALL SELECT NULL, NULL, count(*), 3 FROM o)
SELECT coalesce(status, '(all)') AS status, coalesce(year, 0) AS year, n, CAST(level AS BIGINT) AS level FROM a"""
)
def calendar_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    return P.year_grid(rows, "status", "year").select(F.coalesce("status", F.lit("(all)")).alias("status"), F.coalesce("year", F.lit(0)).alias("year"), "n", "level")


@query("WITH g AS (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text HAVING count(*) > 1) SELECT count(*) AS dup_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra FROM g")
def duplicate_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_groups(table(spark, d, "documents").withColumn("key", F.sha2("text", 256)), ["lang", "key"])


@query("WITH f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang, text ORDER BY source, doc_id) AS duplicate_of FROM documents) SELECT doc_id, duplicate_of FROM f WHERE doc_id <> duplicate_of")
def canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    return P.canonical(rows, ["lang", "key"], ["source"], "doc_id")


@query("WITH t AS (SELECT DISTINCT p_partkey, lower(unnest(string_split(p_name, ' '))) AS keyword FROM part) SELECT keyword, count(*) AS n FROM t GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10")
def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.array_distinct(F.split(M.keyword("p_name"), " "))).alias("keyword"))
    return P.ranked(words, "keyword", 10)


@query("WITH t AS (SELECT DISTINCT p_partkey, p_brand, lower(unnest(string_split(p_name, ' '))) AS keyword FROM part), c AS (SELECT p_brand AS brand, keyword, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, keyword) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def keyword_rank_per_brand(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.explode(F.array_distinct(F.split(M.keyword("p_name"), " "))).alias("keyword"))
    return P.ranked(words, "keyword", 3, ["brand"])


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS band, count(*) AS keys FROM c GROUP BY 1")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.bands(table(spark, d, "orders"), "o_custkey")


@query("SELECT coalesce(l_returnflag, '(all)') AS flag, coalesce(l_linestatus, '(all)') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return got.select(F.coalesce("l_returnflag", F.lit("(all)")).alias("flag"), F.coalesce("l_linestatus", F.lit("(all)")).alias("status"), "n", "quantity")


@query("SELECT coalesce(p_type, '(all)') AS major, coalesce(p_brand, '(all)') AS code, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)")
def code_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_type", "p_brand").count().select(F.coalesce("p_type", F.lit("(all)")).alias("major"), F.coalesce("p_brand", F.lit("(all)")).alias("code"), F.col("count").alias("n"))


@query("SELECT coalesce(nullif(trim(lang), ''), '(none)') AS language, count(*) AS n FROM documents GROUP BY 1")
def language_profile(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "documents").select(F.explode_outer(F.array_distinct(M.values(F.split("lang", ",")))).alias("tag"))
    return tags.groupBy(F.coalesce("tag", F.lit("(none)")).alias("language")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT n FROM c ORDER BY n DESC, o_custkey LIMIT 10) SELECT count(*) AS distinct_keys, CAST(sum(n) AS BIGINT) AS n_rows, CAST((SELECT sum(n) FROM t) AS BIGINT) AS top_rows, round((SELECT sum(n) FROM t) / sum(n), 6) AS top_share FROM c")
def advisor_concentration(spark: SparkSession, d: str) -> DataFrame:
    return P.concentration(table(spark, d, "orders"), "o_custkey", 10).withColumn("top_share", F.round("top_share", 6))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS passed, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS pending, count(*) FILTER (ts IS NULL) AS missing FROM events GROUP BY event_type")
def rights_profile(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < cut).alias("passed"), F.count_if(F.col("ts") >= cut).alias("pending"), F.count_if(F.col("ts").isNull()).alias("missing"))


@query("SELECT source, count(*) AS n, quantile_cont(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM documents GROUP BY source")
def nearest_rank_lengths(spark: SparkSession, d: str) -> DataFrame:
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n_chars)").cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.median("n_chars").alias("median"), disc(0.9).alias("p90"), disc(0.95).alias("p95"), F.max("n_chars").alias("most"))


@query("SELECT 'text' AS \"column\", count(text) AS present, count(*) FILTER (trim(text) <> '') AS filled FROM documents UNION ALL SELECT 'lang', count(lang), count(*) FILTER (trim(lang) <> '') FROM documents UNION ALL SELECT 'source', count(source), count(*) FILTER (trim(source) <> '') FROM documents")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return P.completeness(table(spark, d, "documents"), ["text", "lang", "source"])


@query("WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS token FROM documents), n AS (SELECT count(*)::DOUBLE AS total FROM documents) SELECT token, count(*) AS documents, round(count(*) / any_value(total), 6) AS ratio FROM t, n GROUP BY token HAVING count(*) / any_value(total) >= 0.3")
def stopword_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.document_frequency(table(spark, d, "documents"), "doc_id", M.tokens("text"), 0.3).withColumn("ratio", F.round("ratio", 6))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) SELECT doc_id, lang FROM r WHERE nth <= 7 ORDER BY doc_id LIMIT 20")
def first_per_program(spark: SparkSession, d: str) -> DataFrame:
    return P.first_per_group(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 7, 20)


@query("WITH i AS (SELECT event_id, user_id, event_type = 'error' AS fail, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), s AS (SELECT user_id, island, count(*) AS n FROM i WHERE fail GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) AS streaks FROM s GROUP BY user_id")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return P.streaks(table(spark, d, "events"), "event_id", F.col("event_type") == "error", "user_id")


RANK = "WITH r AS (SELECT doc_id, n_chars, 2 * rank() OVER (ORDER BY n_chars) + count(*) OVER (PARTITION BY n_chars) - 1 AS twice_rank, count(*) OVER () AS total FROM documents)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return P.average_rank(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"])


@query(RANK + " SELECT doc_id, n_chars, round(twice_rank / (2.0 * total), 6) AS percentile_rank FROM r")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("doc_id", "n_chars", F.round("percentile_rank", 6).alias("percentile_rank"))


@query(RANK + " SELECT doc_id, n_chars FROM r WHERE twice_rank * 10 >= total * 18 AND twice_rank * 100 < total * 198")
def mid_range_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.mid_range(_ranks(spark, d), (9, 10), (99, 100)).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT CAST((SELECT ceil(count(*) / 100.0) FROM documents) AS BIGINT)")
def top_share_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.top_share(table(spark, d, "documents").select("doc_id", F.col("n_chars")), "n_chars", "doc_id", (1, 100))


@query("SELECT doc_id, 'DOC-' || substr(sha256(lower(source || '/' || doc_id)), 1, 8) AS doc_code FROM documents")
def document_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.short_code(F.concat_ws("/", "source", F.col("doc_id").cast("string")), "DOC-").alias("doc_code"))


@query("WITH p AS (SELECT 'd' || doc_id AS a, 'd' || (doc_id * 7 % 100) AS b FROM documents) SELECT a, b, 'P-' || substr(sha256(least(a, b) || ':' || greatest(a, b)), 1, 8) AS pair_id FROM p WHERE a <> b")
def pair_codes(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("a"), F.concat(F.lit("d"), F.col("doc_id") * 7 % 100).alias("b")).filter("a <> b")
    return pairs.select("a", "b", M.pair_code("a", "b", "P-").alias("pair_id"))


@query(
    r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00') WHEN 3 THEN strftime(o_orderdate, '%Y-13-%d') ELSE 'n.d.' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 < 3 THEN CAST(CASE o_orderkey % 5 WHEN 0 THEN raw || '-01-01' WHEN 1 THEN raw || '-01' ELSE substr(raw, 1, 10) END AS DATE)::VARCHAR END AS day FROM s"""
)
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy-MM-dd'T00:00'")).when(k == 3, F.date_format(day, "yyyy-'13'-dd")).otherwise("n.d.")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("day", M.partial_day("raw").cast("string"))


@query(
    """WITH s AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '0') AS digits FROM customer), t AS (SELECT *, list_reduce([0] || [CAST(x AS INTEGER) FOR x IN string_split(digits, '')], lambda a, b: (a + b) * 2 % 11) AS m FROM s)
SELECT c_custkey, digits || CASE WHEN (12 - m) % 11 = 10 THEN 'X' ELSE CAST((12 - m) % 11 AS VARCHAR) END AS orcid FROM t"""
)
def check_digits(spark: SparkSession, d: str) -> DataFrame:
    digits = F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0")
    return table(spark, d, "customer").select("c_custkey", F.concat(digits, M.check_digit(digits)).alias("orcid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ' / ' || user_id % 5 AS tags, split_part(event_type, 'i', -1) AS tail FROM events")
def event_metadata(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    tags = M.values(F.array(F.col("event_type"), F.lit("  "), F.concat(F.lit(" "), (F.col("user_id") % 5).cast("string"))))
    safe = M.without_keys(F.map_concat(props, F.create_map(F.lit("person.dni"), F.lit("1"))), ".dni")
    return table(spark, d, "events").select("event_id", F.element_at(safe, "k").cast("long").alias("k"), F.array_join(tags, " / ").alias("tags"), M.after_last("event_type", "i").alias("tail"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY least_turn) AS roles, count(*) AS distinct_roles FROM (SELECT conv_id, role, min(turn) AS least_turn FROM conversations GROUP BY ALL) GROUP BY conv_id")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.array_distinct(F.transform("t", lambda x: x["role"]))
    return turns.select("conv_id", F.array_join(roles, ",").alias("roles"), F.size(roles).cast("long").alias("distinct_roles"))


@query("WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}]+') AS ws FROM conversations), b AS (SELECT conv_id, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS bigram FROM t) SELECT bigram, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM b GROUP BY bigram HAVING count(*) >= 5")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", F.explode(M.bigrams(M.tokens("text"))).alias("bigram"))
    return turns.groupBy("bigram").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations")).filter("n >= 5")


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '#', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS line_key, count(DISTINCT doc_id) AS documents FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def running_line_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", M.line_key("line").alias("line_key")).distinct()
    return lines.groupBy("line_key").agg(F.count("*").alias("documents")).filter("documents >= 5")


@query("WITH c AS (SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey), o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region, coalesce(n, 0) AS orders, coalesce(most, 0) AS most FROM c LEFT JOIN o ON o_custkey = c_custkey")
def outer_join_records(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("most"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    got = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(spent, "c_custkey", "left")
    return got.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS without_label, count(*) FILTER (d.doc_id IS NULL) AS without_document, count(*) FILTER (l.doc_id = d.doc_id) AS matched FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def cardinality_check(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "documents").select(F.col("doc_id").alias("a")).distinct(), table(spark, d, "labels").select(F.col("doc_id").alias("b")).distinct()
    return left.join(right, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("b").isNull()).alias("without_label"), F.count_if(F.col("a").isNull()).alias("without_document"), F.count_if(F.col("a") == F.col("b")).alias("matched"))


@query("WITH w AS (SELECT unnest(range(0, 2000, 13)) AS doc_id) SELECT w.doc_id, d.doc_id IS NOT NULL AS known FROM w LEFT JOIN documents d USING (doc_id)")
def subset_with_unknown(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(0, 2000, 13).withColumnRenamed("id", "doc_id")
    docs = table(spark, d, "documents").select("doc_id").distinct()
    return wanted.join(docs, "doc_id", "left_semi").withColumn("known", F.lit(True)).union(wanted.join(docs, "doc_id", "left_anti").withColumn("known", F.lit(False)))


@query("SELECT p_type AS topic, string_agg(p_brand || ':' || n, ',' ORDER BY n DESC, p_brand) AS programs FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type")
def programs_per_topic(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "p_brand", "n")))
    return counts.groupBy(F.col("p_type").alias("topic")).agg(F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x["p_brand"], x["n"].cast("string"))), ",").alias("programs"))


@query(
    "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents), n AS (SELECT count(*)::DOUBLE AS total FROM documents), s AS (SELECT word, count(*) AS documents, count(*) / any_value(total) AS ratio FROM t, n GROUP BY word), l AS (SELECT unnest(['the', 'of', 'zzzz']) AS word) SELECT word, coalesce(documents, 0) AS documents, round(coalesce(ratio, 0), 6) AS ratio, true AS listed FROM l LEFT JOIN s USING (word) UNION ALL SELECT word, documents, round(ratio, 6), false FROM s ANTI JOIN l USING (word) WHERE ratio >= 0.5"
)
def stopword_recheck(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([("the",), ("of",), ("zzzz",)], "word string")
    return P.stopword_recheck(table(spark, d, "documents"), "doc_id", M.tokens("text"), listed, 0.5).withColumn("ratio", F.round("ratio", 6))


@query(
    r"WITH r AS (SELECT length(text) AS chars, len(regexp_split_to_array(trim(text), '[ \t\n\x0b\f\r]+')) AS words, len(regexp_split_to_array(trim(text), '[ \t\n\x0b\f\r]+')) + 2 AS tokens FROM documents WHERE trim(text) <> ''), o AS (SELECT round(avg((tokens > 512)::INT), 6) AS share_over_limit FROM r), m AS (SELECT 'chars' AS measure, chars AS v FROM r UNION ALL SELECT 'words', words FROM r UNION ALL SELECT 'tokens', tokens FROM r) SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, max(v) AS most, any_value(share_over_limit) AS share_over_limit FROM m, o GROUP BY measure"
)
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    size = F.size(F.split(F.trim("text"), r"\s+")) + 2
    return P.length_profile(table(spark, d, "documents"), "text", size, 512).withColumns({c: F.round(c, 6) for c in ("mean", "share_over_limit")})
