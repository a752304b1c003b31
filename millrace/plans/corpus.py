"""Corpus queries over ``documents``: cleaning, exact and near duplicates, stories, statistics.

Stand-ins: the time of a document is 2016-01-01 plus doc_id hours, its title the first 40
characters; blocks are its lines; the native alphabet is that of the four languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean as C
from ..operators import dedup as D
from ..operators import stories as S
from ..session import settle, table
from .base import query

DT = "TIMESTAMP '2016-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR"
#: Characters that comparison keys treat as spaces, for the SQL side.
PUNCT = X.PUNCTUATION.replace("'", "''")
def _key(column: str) -> str:
    return f"trim(regexp_replace(translate(lower({column}), '{PUNCT}', '{' ' * len(X.PUNCTUATION)}'), '\\s+', ' ', 'g'))"


WORDED = f"worded AS (SELECT doc_id, source, text, CASE WHEN {_key('text')} = '' THEN []::VARCHAR[] ELSE string_split({_key('text')}, ' ') END AS ws FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumn("dt_utc", F.expr("timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP '2016-01-01 00:00:00')")).withColumn("title", F.substring("text", 1, 40))


def _blocks(d: DataFrame):
    return F.split("text", "\n")


CHECKED = f"""checked AS (
  SELECT doc_id, false AS no_date, coalesce(length(trim(left(text, 40))) < 10, true) AS no_title, coalesce(length(text) <= 200, true) AS short_text,
    coalesce((own + other)::DOUBLE / nullif(length(text), 0) <= 0.6, true) AS low_letter_share, coalesce(own::DOUBLE / nullif(own + other, 0) < 0.85, true) AS not_ru
  FROM (SELECT *, len(regexp_extract_all(text, '[a-zA-Z]')) AS own, len(regexp_extract_all(text, '[À-ÿ]')) AS other FROM documents)
)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flagged(_docs(spark, sf_dir), native="[a-zA-Z]", latin="[À-ÿ]")


@query(f"WITH {CHECKED} SELECT * FROM checked")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", *C.CHECKS)


@query(f"""WITH {CHECKED} SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in C.CHECKS)}], lambda x: x IS NOT NULL), ';') AS reason
FROM checked WHERE no_date OR no_title OR short_text OR low_letter_share OR not_ru""")
def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split(_checked(spark, sf_dir))[1].select("doc_id", "reason")


@query(f"WITH {CHECKED} SELECT doc_id FROM checked WHERE NOT (no_date OR no_title OR short_text OR low_letter_share OR not_ru)")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split(_checked(spark, sf_dir))[0].select("doc_id")


@query(f"WITH {CHECKED} " + " UNION ALL ".join(f"SELECT '{c}' AS check, count(*) FILTER ({c}) AS records, 100.0::DOUBLE * count(*) FILTER ({c}) / count(*) AS pct FROM checked" for c in C.CHECKS))
def reject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reject_stats(_checked(spark, sf_dir))


BOILER = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM documents),
boiler AS (SELECT key, count(*) AS docs FROM (SELECT DISTINCT doc_id, {_key('block')} AS key FROM lines WHERE length(block) > 20 AND length(block) <= 400) WHERE key <> '' GROUP BY key HAVING count(*) >= 20)"""


@query(f"WITH {BOILER} SELECT * FROM boiler")
def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return C.boilerplate(d, _blocks(d))


@query(f"""WITH {BOILER}, numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS block, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents
), kept AS (
  SELECT doc_id, min(pos) AS pos, arg_min(block, pos) AS block FROM (SELECT *, {_key('block')} AS key FROM numbered) WHERE key <> '' AND key NOT IN (SELECT key FROM boiler) GROUP BY doc_id, key
)
SELECT d.doc_id, coalesce(string_agg(block, chr(10) ORDER BY pos), '') AS text FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""")
def without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return C.without_boilerplate(d, "doc_id", _blocks(d), C.boilerplate(d, _blocks(d)))


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.normalize(F.col("text")).alias("text"))


@query()
def junk_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _docs(spark, sf_dir).select("doc_id", X.drop_junk(F.col("text"), X.sentences(F.col("text")), none).alias("text"))


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]{{1,200}}>', ' ', 'g'), '\\s+', ' ', 'g'), ' ([,.;:!?%])', '\\1', 'g')) AS squeezed, {_key('text')} AS key FROM documents""")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.squeeze(F.regexp_replace("text", "<[^>]{1,200}>", " ")).alias("squeezed"), X.comparison_key(F.col("text")).alias("key"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]'))::INTEGER AS latin, len(regexp_extract_all(text, '[À-ÿ]'))::INTEGER AS accented, len(regexp_extract_all(text, '[0-9]'))::INTEGER AS digits FROM documents")
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin, accented = X.letter_counts(F.col("text"), "[a-zA-Z]", "[À-ÿ]")
    return table(spark, sf_dir, "documents").select("doc_id", latin.alias("latin"), accented.alias("accented"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"))


@query("""SELECT doc_id, trim(left(text, 40)) || chr(10) || chr(10) || left(trim(text), 1500) AS model_input, left(sha256(coalesce(text, '')), 8) AS version,
'a_' || lpad(doc_id::VARCHAR, 7, '0') AS article_id, replace(lower(text), 'ё', 'е') AS folded FROM documents""")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.model_input(F.col("title"), F.col("text")).alias("model_input"), X.short_digest(F.coalesce("text", F.lit("")), 8).alias("version"), X.numbered("a", F.col("doc_id"), 7).alias("article_id"), X.fold_yo(F.col("text")).alias("folded"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*'), ' ') AS tokens FROM documents")
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.topic_tokens(F.col("text"), "a-zà-ÿ"), " ").alias("tokens"))


@query("""SELECT doc_id, '{"chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || '}' AS dump FROM documents""")
def canonical_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_json(lang=F.col("lang"), chars=F.col("n_chars"), doc_id=F.col("doc_id")).alias("dump"))


@query(f"""WITH {WORDED}, k AS (SELECT doc_id, sha256(array_to_string(ws, ' ')) AS digest FROM worded WHERE len(ws) > 0)
SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS first, count(*) OVER (PARTITION BY digest) AS size FROM k""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_groups(table(spark, sf_dir, "documents"))


NEAR = f"""{WORDED}, firsts AS (SELECT min(doc_id) AS doc_id, any_value(ws) AS ws FROM worded WHERE len(ws) >= 5 GROUP BY array_to_string(ws, ' ')),
each AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - 4)) AS i FROM firsts)),
sizes AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
near AS (
  SELECT c.a, c.b, c.common::DOUBLE / (x.n + y.n - c.common) AS score
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM each p JOIN each q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2) c
  JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE c.common::DOUBLE / (x.n + y.n - c.common) >= 0.8
)"""


@query(f"WITH {NEAR} SELECT a, b, score FROM near")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(D.shingle_sets(table(spark, sf_dir, "documents")))


@query()
def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lsh_pairs(D.shingle_sets(table(spark, sf_dir, "documents")))


PAIRS = f"""{NEAR}, hashed AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) AS first FROM worded WHERE len(ws) > 0),
pairs AS (SELECT first AS a, doc_id AS b, 'exact' AS level, 1.0::DOUBLE AS score FROM hashed WHERE first <> doc_id UNION ALL SELECT a, b, 'minhash', score FROM near)"""
STORIES = f"""{PAIRS}, reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT r.x, CASE WHEN p.a = r.y THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON p.a = r.y OR p.b = r.y
), comp AS (SELECT x AS "row", min(y) AS component FROM reach GROUP BY x),
placed AS (SELECT c."row", d.source, d.doc_id AS dt, length(d.text) AS text_len, component FROM comp c JOIN documents d ON d.doc_id = c."row"),
story_firsts AS (SELECT component, min("row") AS f, count(*) AS story_size FROM placed GROUP BY component),
named AS (SELECT component, story_size, 's_' || lpad((row_number() OVER (ORDER BY f) - 1)::VARCHAR, 6, '0') AS story_id FROM story_firsts),
stories AS (
  SELECT "row", source, story_id, story_size, row_number() OVER (PARTITION BY p.component ORDER BY text_len DESC NULLS LAST, dt, "row") = 1 AS is_canonical
  FROM placed p JOIN named n ON n.component = p.component
)"""


def _pairs(spark: SparkSession, sf_dir: str, forest: bool = False, apart: DataFrame | None = None) -> DataFrame:
    """Exact and near pairs; with ``forest`` only as many near ones, but those of ``apart``, as hold their components together."""
    d = table(spark, sf_dir, "documents")
    groups, sets = D.groups_and_sets(d)
    near = D.near_pairs(sets, forest=forest, apart=apart).select("a", "b", F.lit("minhash").alias("level"), "score")
    return D.exact_pairs(d, groups=groups).unionByName(near)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""WITH {PAIRS}, ends AS (SELECT level, a AS x FROM pairs UNION ALL SELECT level, b FROM pairs)
SELECT level, (SELECT count(*) FROM pairs p WHERE p.level = e.level) AS pairs, count(DISTINCT x) AS articles, 100.0::DOUBLE * count(DISTINCT x) / (SELECT count(*) FROM documents) AS pct FROM ends e GROUP BY level""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.level_stats(_pairs(spark, sf_dir), table(spark, sf_dir, "documents").agg(F.count("*").alias("n")))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _docs(spark, sf_dir).select(F.col("doc_id").alias("row"), "source", F.col("dt_utc").alias("dt"), F.length("text").alias("text_len"))
    return S.story_map(articles, S.split_stories(_pairs(spark, sf_dir, forest=True)), canonical="longest")


@query(f'WITH RECURSIVE {STORIES} SELECT "row", source, story_id, story_size, is_canonical FROM stories')
def story_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stories(spark, sf_dir).drop("dt")


@query(f"""WITH RECURSIVE {STORIES}, c AS (SELECT story_size AS size, count(*) FILTER (is_canonical) AS stories, count(*) AS articles FROM stories GROUP BY 1)
SELECT *, articles::DOUBLE / sum(articles) OVER ()::DOUBLE AS share FROM c""")
def story_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_distribution(_stories(spark, sf_dir))


@query(f"""WITH RECURSIVE {STORIES} SELECT g.size, count(s.story_id) AS stories FROM (SELECT unnest(generate_series(1, 10)) AS size) g
LEFT JOIN (SELECT story_id, least(count(*), 10) AS size FROM stories GROUP BY 1) s ON s.size = g.size GROUP BY g.size""")
def story_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_histogram(_stories(spark, sf_dir))


@query(f"""WITH RECURSIVE {STORIES}, c AS (SELECT story_id, count(*) AS size FROM stories GROUP BY 1)
SELECT sum(size)::BIGINT AS articles, count(*) AS stories, count(*) FILTER (size = 1) AS singles, max(size) AS largest, sum(size)::DOUBLE / count(*) AS articles_per_story FROM c""")
def story_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compression(_stories(spark, sf_dir))


@query(f"""WITH RECURSIVE {STORIES} SELECT story_id, count(DISTINCT source) AS sources, count(*) AS size FROM stories GROUP BY story_id HAVING count(*) > 1
ORDER BY sources DESC, size DESC, story_id LIMIT 3""")
def widest_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.widest_stories(_stories(spark, sf_dir))


@query("""SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS null_texts, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(length(text))::BIGINT AS chars,
min(length(text)) AS shortest, max(length(text)) AS longest, count(*) FILTER (text = '') AS empty_texts FROM documents""")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("text").isNull()).alias("null_texts"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.sum(n).alias("chars"),
        F.min(n).cast("long").alias("shortest"),
        F.max(n).cast("long").alias("longest"),
        F.count_if(F.col("text") == "").alias("empty_texts"),
    )


@query("""SELECT year(o_orderdate)::INTEGER AS year, count(*) AS orders, 100.0::DOUBLE * count(*) / sum(count(*)) OVER ()::DOUBLE AS pct, sum(length(o_orderpriority))::BIGINT AS chars, avg(length(o_orderpriority)) AS mean_len
FROM orders GROUP BY 1""")
def per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("o_orderpriority")
    by = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.sum(n).alias("chars"), F.avg(n).alias("mean_len"))
    total = F.sum("orders").over(S.Window.rowsBetween(S.Window.unboundedPreceding, S.Window.unboundedFollowing))
    return by.select("year", "orders", (F.lit(100.0) * F.col("orders") / total.cast("double")).alias("pct"), "chars", "mean_len")


@query("SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM orders) WHERE day LIKE '1996%'")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    return o.where(F.col("day").startswith("1996"))


@query("""SELECT least(floor(length(text) / 500.0), 40)::INTEGER AS bin, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.groupBy(F.least(F.floor(F.length("text") / 500), F.lit(40)).cast("int").alias("bin")).agg(F.count("*").alias("documents"))


@query("""SELECT count(text) AS n, avg(length(text)) AS mean, round(stddev_samp(length(text)), 6) AS std, quantile_cont(length(text)::DOUBLE, 0.25) AS q25,
quantile_cont(length(text)::DOUBLE, 0.5) AS median, quantile_cont(length(text)::DOUBLE, 0.9) AS q90 FROM documents""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("double")
    q = lambda p, a: F.percentile(n, F.lit(p)).alias(a)
    return table(spark, sf_dir, "documents").agg(F.count("text").alias("n"), F.avg(n).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), q(0.25, "q25"), q(0.5, "median"), q(0.9, "q90"))


@query("""SELECT source, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Moscow')::DATE AS day, count(*) AS articles FROM (SELECT source, TIMESTAMP '2016-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS ts FROM documents) GROUP BY ALL""")
def articles_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source", F.to_date(F.from_utc_timestamp("dt_utc", "Europe/Moscow")).alias("day")).agg(F.count("*").alias("articles"))


VEC = "rows_ AS (SELECT vec_id AS id, vec_id * 3600 AS t, embedding::DOUBLE[] AS v, label AS kind FROM embeddings)"


@query(f"""WITH {VEC} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 6) AS score FROM rows_ a JOIN rows_ b
ON (b.t > a.t OR (b.t = a.t AND b.id > a.id)) AND b.t - a.t <= 259200 WHERE list_inner_product(a.v, b.v) >= 0.3""")
def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("ts"), F.col("embedding").alias("v"))
    return D.band_pairs(v, threshold=0.3).withColumn("score", F.round("score", 6))


#: Semantic edges are cut in steps inside components of more than SPLIT_SIZE documents.
SPLIT_SIZE, SPLIT_START, SPLIT_STEP, SPLIT_CAP = 10, 0.3, 0.1, 0.5


def _split_sql() -> str:
    """Components of all three levels' edges, split round by round; the last round's are final."""
    out = [
        f"{VEC}",
        "sem AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS score FROM rows_ a JOIN rows_ b ON (b.t > a.t OR (b.t = a.t AND b.id > a.id)) AND b.t - a.t <= 259200 WHERE list_inner_product(a.v, b.v) >= 0.3)",
        "levels AS (SELECT a, b, level, score, CASE level WHEN 'exact' THEN 0 ELSE 1 END AS o FROM pairs UNION ALL SELECT least(a, b), greatest(a, b), 'semantic', score, 2 FROM sem)",
        "e0 AS MATERIALIZED (SELECT a, b, arg_max(level, o) AS level, arg_max(score, o) AS score FROM levels GROUP BY a, b)",
        "nodes AS (SELECT a AS node FROM e0 UNION SELECT b FROM e0)",
    ]
    k, threshold = 0, SPLIT_START
    while True:
        out.append(f"s{k} AS MATERIALIZED (SELECT a, b FROM e{k} UNION SELECT b, a FROM e{k})")
        out.append(f"w{k}(x, y) AS (SELECT node, node FROM nodes UNION SELECT w.x, s.b FROM w{k} w JOIN s{k} s ON s.a = w.y)")
        out.append(f"c{k} AS MATERIALIZED (SELECT x AS node, min(y) AS component FROM w{k} GROUP BY x)")
        if threshold >= SPLIT_CAP:
            return ", ".join(out) + f", final_ AS (SELECT * FROM c{k})"
        threshold = round(threshold + SPLIT_STEP, 4)
        out.append(f"z{k} AS (SELECT component, count(*) AS n FROM c{k} GROUP BY 1)")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT e.* FROM e{k} e JOIN c{k} c ON c.node = e.a JOIN z{k} z USING (component) WHERE NOT (z.n > {SPLIT_SIZE} AND level = 'semantic' AND score < {threshold}))")
        k += 1


@query(f"WITH RECURSIVE {PAIRS}, {_split_sql()} SELECT node, component FROM final_")
def semantic_story_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories over exact, near and semantic edges, an embedding's number being that of its document."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("ts"), F.col("embedding").alias("v"))
    semantic = settle(D.band_pairs(v, threshold=0.3).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("semantic").alias("level"), "score"))
    # a near pair that is a semantic one too may be cut as such, so it is none of those that hold the near ones together
    pairs = _pairs(spark, sf_dir, forest=True, apart=semantic)
    return S.split_stories(pairs.unionByName(semantic), SPLIT_SIZE, SPLIT_START, SPLIT_STEP, SPLIT_CAP)


NEAREST = f"""{VEC}, knn AS (
  SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r
  FROM rows_ a JOIN rows_ b ON a.kind = b.kind AND a.id <> b.id
), nearest AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM knn WHERE r <= 10 AND score >= 0.3 GROUP BY 1, 2)"""


@query(f"WITH {NEAREST} SELECT a, b, score FROM nearest")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("v"))
    return D.knn_pairs(v, threshold=0.3).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(D.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100)
