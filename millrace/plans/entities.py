"""Entity queries. Stand-in: each line of ``lineitem`` is a mention of its part in the article ``l_orderkey``."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import mentions as M
from ..operators import resolve as R
from ..operators.graph import connected_components
from ..session import settle, table
from ..operators.order import numbered
from .base import query
from .corpus import NEAREST, nearest_neighbours

NAME = "CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('«', p_name, '»') ELSE p_name END"
TYPE = "CASE (p_size + l_linenumber) % 7 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'ORG' END"
FIELDS = f"""l_orderkey AS article_id, l_suppkey AS story_id, l_returnflag AS source, CAST(l_shipdate AS DATE) AS date, {NAME} AS name, {TYPE} AS type,
  CASE l_linenumber % 3 WHEN 0 THEN 'actor' WHEN 1 THEN 'object' ELSE 'mentioned' END AS role,
  CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neu' WHEN 2 THEN 'neg' ELSE 'unknown' END AS sentiment, l_discount AS confidence,
  CASE WHEN p_brand <> 'Brand#1' THEN concat(p_type, ' ', CAST(CAST(p_size AS INT) % 3 AS STRING)) END AS normalized_llm, l_linenumber, l_extendedprice"""
BASE = f"mentions AS (SELECT {FIELDS.replace('AS STRING', 'AS VARCHAR')} FROM lineitem JOIN part ON p_partkey = l_partkey)"
KEYED = f"{BASE}, keyed AS (SELECT *, trim(lower(translate(name, '«»', '  '))) AS alias_key FROM mentions)"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr(*[f"{x}" for x in _columns(FIELDS)])


def _columns(fields: str) -> list[str]:
    """Select expressions of a comma-separated list, commas inside brackets kept."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with their keys, settled; each distinct (name, type) is cleaned once."""
    mentions = _mentions(spark, sf_dir)
    names = mentions.select("name", "type").distinct().withColumn("alias_key", X.clean_form(F.col("name"), F.col("type")))
    return settle(mentions.join(names, ["name", "type"], "left"))


FORMS = """forms AS (SELECT name, type, any_value(alias_key) AS alias_key, count(*) AS n_mentions, count(DISTINCT article_id) AS n_docs, count(DISTINCT story_id) AS n_stories, count(DISTINCT source) AS n_sources,
  min(date) AS first_seen, max(date) AS last_seen, avg(confidence) AS conf_mean FROM keyed GROUP BY name, type)"""
NORM = f"""{FORMS}, ty AS (
  SELECT alias_key, max(CASE WHEN r = 1 THEN type END) AS type, coalesce(bool_or(CASE WHEN r = 2 THEN share >= 0.2 END), false) AS type_ambiguous FROM (
    SELECT alias_key, type, sum(n_mentions)::DOUBLE / sum(sum(n_mentions)) OVER (PARTITION BY alias_key)::DOUBLE AS share, row_number() OVER (PARTITION BY alias_key ORDER BY sum(n_mentions) DESC, type) AS r FROM forms GROUP BY 1, 2) GROUP BY 1
), md AS (
  SELECT alias_key, normalized_llm, llm_norm_agree FROM (SELECT alias_key, normalized_llm, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY alias_key)::DOUBLE AS llm_norm_agree,
    row_number() OVER (PARTITION BY alias_key ORDER BY normalized_llm IS NULL, count(*) DESC, normalized_llm) AS r FROM keyed GROUP BY 1, 2) WHERE r = 1 AND normalized_llm IS NOT NULL
), tops AS (SELECT alias_key, name AS top_surface FROM (SELECT alias_key, name, row_number() OVER (PARTITION BY alias_key ORDER BY n_mentions DESC, name) AS r FROM forms) WHERE r = 1),
norm AS (
  SELECT c.*, ty.type, type_ambiguous, normalized_llm, llm_norm_agree, top_surface, n_stories > 1 AND NOT regexp_matches(c.alias_key, '^(\\d+([.,]\\d+)?\\s*%|\\d+-летн|[\\d\\s.,]+$)') AS active,
    row_number() OVER (ORDER BY n_stories DESC, n_mentions DESC, c.alias_key) - 1 AS form_id
  FROM (SELECT alias_key, count(DISTINCT story_id) AS n_stories, count(*) AS n_mentions FROM keyed GROUP BY 1) c JOIN ty USING (alias_key) JOIN tops USING (alias_key) LEFT JOIN md USING (alias_key)
)"""
VOTES = f"""{KEYED}, {NORM}, votes AS (
  SELECT type, alias_key AS key, form_id FROM norm WHERE active UNION SELECT type, lower(normalized_llm), form_id FROM norm WHERE active AND trim(normalized_llm) <> ''
), grp AS (SELECT type, key, count(*) AS n, min(form_id) AS least FROM votes GROUP BY 1, 2 HAVING count(*) > 1),
vp AS (
  SELECT x.form_id AS a, y.form_id AS b FROM grp g JOIN votes x ON x.type = g.type AND x.key = g.key JOIN votes y ON y.type = g.type AND y.key = g.key WHERE n <= 4 AND x.form_id < y.form_id
  UNION SELECT least, x.form_id FROM grp g JOIN votes x ON x.type = g.type AND x.key = g.key WHERE n > 4 AND x.form_id > least
)"""
CLUSTERS = f"""{VOTES}, reach(x, y) AS (SELECT form_id, form_id FROM norm UNION SELECT r.x, CASE WHEN v.a = r.y THEN v.b ELSE v.a END FROM reach r JOIN vp v ON v.a = r.y OR v.b = r.y),
cl AS (SELECT x AS form_id, min(y) AS cluster FROM reach GROUP BY x), full_ AS (SELECT norm.*, cluster FROM norm JOIN cl USING (form_id)),
sur AS (SELECT alias_key, count(*) AS surfaces FROM forms GROUP BY 1),
meth AS (SELECT f.*, CASE WHEN count(*) OVER (PARTITION BY cluster) > 1 THEN 'llm' WHEN surfaces > 1 THEN 'rule' ELSE 'singleton' END AS method FROM full_ f JOIN sur USING (alias_key)),
nomi AS (SELECT cluster, name AS first FROM (SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY n_mentions DESC, name) AS r FROM (
  SELECT m.cluster, f.name, f.n_mentions FROM forms f JOIN meth m USING (alias_key) WHERE trim(lower(translate(f.name, '«»', '  '))) = f.alias_key)) WHERE r = 1),
canon AS (SELECT f.cluster, coalesce(first, normalized_llm, top_surface) AS canonical FROM full_ f LEFT JOIN nomi USING (cluster) WHERE f.form_id = f.cluster),
sizes AS (SELECT m.cluster, count(*) AS n_mentions FROM keyed k JOIN meth m USING (alias_key) GROUP BY 1),
ids AS (SELECT s.cluster, f.type, c.canonical, s.n_mentions, lower(f.type) || '_' || lpad((row_number() OVER (PARTITION BY f.type ORDER BY s.n_mentions DESC, c.canonical))::VARCHAR, 6, '0') AS entity_id
  FROM sizes s JOIN full_ f ON f.form_id = s.cluster JOIN canon c ON c.cluster = s.cluster)"""


@dataclass
class Dictionary:
    """Mentions with keys, surface forms and the alias dictionary, each settled once."""

    keyed: DataFrame
    forms: DataFrame
    norm: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, sf_dir: str) -> "Dictionary":
        keyed = _keyed(spark, sf_dir)
        forms = settle(M.surface_forms(keyed, ["name", "type", "alias_key"]))
        return cls(keyed, forms, settle(M.alias_dictionary(forms, keyed)))

    def votes(self) -> DataFrame:
        return settle(M.vote_pairs(self.norm.where("active"), max_group=4))

    def clustered(self) -> "Dictionary":
        """The dictionary with cluster and method, every vote being accepted."""
        parts = connected_components(self.votes(), "a", "b").withColumnRenamed("node", "form_id").withColumnRenamed("component", "cluster")
        out = self.norm.join(parts, "form_id", "left").withColumn("cluster", F.coalesce("cluster", "form_id"))
        surfaces = self.forms.groupBy("alias_key").agg(F.count("*").alias("surfaces"))
        sizes = out.groupBy("cluster").agg(F.count("*").alias("aliases"))
        named = out.join(surfaces, "alias_key").join(sizes, "cluster").withColumn("method", M.method_of(F.col("aliases"), F.col("surfaces")))
        return Dictionary(self.keyed, self.forms, settle(named))

    def entity_ids(self) -> DataFrame:
        """(cluster, type, canonical, n_mentions, entity_id) of a clustered dictionary."""
        link = self.norm.select("alias_key", "cluster")
        named = M.canonical_names(self.forms.join(link, "alias_key"), self.norm)
        sizes = self.forms.join(link, "alias_key").groupBy("cluster").agg(F.sum("n_mentions").alias("n_mentions"))
        roots = self.norm.where("form_id = cluster").select("cluster", "type")
        return M.number_entities(sizes.join(roots, "cluster").join(named, "cluster"))


@query(f"WITH {BASE} SELECT article_id, name, type, role, sentiment, grounded, normalized_llm FROM (SELECT *, contains('small ring and red widget', name) AS grounded FROM mentions)")
def exploded_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    entity = F.struct("name", "type", "role", "sentiment", F.col("normalized_llm").alias("normalized_id"))
    docs = m.groupBy("article_id").agg(F.collect_list(entity).alias("entities"), F.min("story_id").alias("story_id"), F.min("date").alias("date"), F.min("source").alias("source"), F.min("confidence").alias("confidence"))
    out = M.explode_mentions(docs.withColumn("text", F.lit("small ring and red widget")))
    return out.select("article_id", "name", "type", "role", "sentiment", "grounded", "normalized_llm")


@query(f"WITH {KEYED}, {FORMS} SELECT name, type, n_mentions, n_docs, n_stories, n_sources, first_seen, last_seen, round(conf_mean, 9) AS conf_mean FROM forms")
def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.surface_forms(_mentions(spark, sf_dir)).withColumn("conf_mean", F.round("conf_mean", 9))


@query(f"WITH {KEYED}, {NORM} SELECT * FROM md")
def normalization_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.normalization_mode(_keyed(spark, sf_dir), "alias_key")


@query(f"""WITH {KEYED} SELECT alias_key, arg_max('order ' || o_orderkey, {{'s': o_custkey, 'k': -o_orderkey}}) AS sample_title FROM keyed JOIN orders ON o_orderkey = article_id GROUP BY alias_key""")
def sample_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_custkey").alias("story_size"))
    return M.sample_titles(_keyed(spark, sf_dir), articles, "alias_key")


@query(f"WITH {KEYED}, {NORM} SELECT * FROM norm")
def alias_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dictionary.read(spark, sf_dir).norm.drop("variants")


@query(f"""WITH {KEYED}, {FORMS} SELECT alias_key, string_agg(name, '|' ORDER BY n_mentions DESC, name) AS variants FROM (SELECT alias_key, name, max(n_mentions) AS n_mentions FROM forms GROUP BY 1, 2) GROUP BY 1""")
def surface_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.variants(M.surface_forms(_keyed(spark, sf_dir), ["name", "type", "alias_key"]), "alias_key").select("alias_key", F.array_join("variants", "|").alias("variants"))


@query(f"WITH {VOTES} SELECT * FROM vp")
def vote_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dictionary.read(spark, sf_dir).votes()


MERGED = f"{VOTES}, {NEAREST}, mg AS (SELECT a, b, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels, max(score) AS score FROM (SELECT a, b, 'emb' AS channel, score FROM nearest UNION ALL SELECT a, b, 'llm_vote', NULL FROM vp) GROUP BY 1, 2)"
#: Accepted pairs of the stand-in: all votes, the closest neighbours, and forms 59 places apart, which nothing proposed.
ACCEPTED = "SELECT a, b FROM vp UNION SELECT a, b FROM nearest WHERE score >= 0.5 UNION SELECT form_id, form_id + 59 FROM norm"


def _merged(spark: SparkSession, sf_dir: str, votes: DataFrame) -> DataFrame:
    """Candidate edges of both channels; the number of an embedding stands for that of a form."""
    return M.merge_edges(nearest_neighbours(spark, sf_dir), votes)


@query(f"WITH {MERGED} SELECT a, b, channels, score FROM mg")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, Dictionary.read(spark, sf_dir).votes()).withColumn("channels", F.array_join("channels", "+"))


@query(f"""WITH {MERGED} SELECT CASE WHEN m.channels IS NULL THEN 'transitive' WHEN contains(m.channels, '+') THEN 'both' ELSE m.channels END AS channel, count(*) AS pairs
FROM ({ACCEPTED}) p LEFT JOIN mg m USING (a, b) GROUP BY 1""")
def channel_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = Dictionary.read(spark, sf_dir)
    votes = known.votes()
    near = nearest_neighbours(spark, sf_dir).where("score >= 0.5").select("a", "b")
    apart = known.norm.select(F.col("form_id").alias("a"), (F.col("form_id") + 59).alias("b"))
    return M.channel_contribution(votes.unionByName(near).unionByName(apart).distinct(), _merged(spark, sf_dir, votes))


#: Organisations named after their nation or by it; nations from number 10 on are met often enough for the gazetteer.
GEO = """geo AS (
  SELECT s_suppkey AS form_id, 'ORG' AS type, CASE s_suppkey % 3 WHEN 0 THEN 'office' WHEN 1 THEN concat('office по ', replace(lower(n_name), ' ', '_')) ELSE concat('office ', replace(lower(n_name), ' ', '_')) END AS alias_key,
    true AS active, 50 AS n_stories, s_suppkey % 3 AS named, n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 1000000000 + n_nationkey, 'LOC', replace(lower(n_name), ' ', '_'), true, 90 + n_nationkey, 3, n_nationkey FROM nation)"""


@query(f"""WITH {GEO}, m AS (SELECT form_id, CASE WHEN type <> 'ORG' THEN NULL WHEN named = 0 OR n_nationkey < 10 THEN '' ELSE alias_key_of END AS mark FROM (SELECT g.*, replace(lower(n.n_name), ' ', '_') AS alias_key_of FROM geo g JOIN nation n USING (n_nationkey))),
e AS (SELECT x.form_id AS a, y.form_id AS b FROM geo x JOIN geo y ON y.form_id > x.form_id AND (y.form_id - x.form_id <= 5 OR (y.form_id - 1000000000 = x.n_nationkey)))
SELECT a::BIGINT AS a, b::BIGINT AS b FROM e LEFT JOIN m x ON x.form_id = a LEFT JOIN m y ON y.form_id = b WHERE x.mark IS NULL OR y.mark IS NULL OR x.mark = y.mark""")
def geo_consistent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("supplier", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    f = spark.sql(f"WITH {GEO} SELECT CAST(form_id AS BIGINT) AS form_id, type, alias_key, active, n_stories, n_nationkey FROM geo")
    ids = f.select(F.col("form_id").alias("b"))
    close = f.select(F.col("form_id").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("form_id") + k)).alias("b")).join(ids, "b")
    placed = f.select(F.col("form_id").alias("a"), (F.col("n_nationkey") + 1_000_000_000).alias("b")).where("a < b")
    e = close.select("a", "b").unionByName(placed).distinct().withColumn("channels", F.array(F.lit("emb"))).withColumn("score", F.lit(0.9))
    return M.drop_geo_conflicts(e, f, M.gazetteer(f)).select("a", "b")


@query()
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidate_groups(_merged(spark, sf_dir, Dictionary.read(spark, sf_dir).votes()), max_size=5)


GROUPS = "g0 AS (SELECT p_type AS type, p_brand AS name, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT type, row_number() OVER (ORDER BY type, name) AS \"group\", n FROM g0), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY \"group\") AS k FROM g)"


@query(f"""WITH RECURSIVE {GROUPS}, fold AS (
  SELECT type, k, "group", 0 AS batch, 0::BIGINT AS first, n::BIGINT AS fill FROM o WHERE k = 1 UNION ALL
  SELECT o.type, o.k, o."group", f.batch + (f.fill > 0 AND f.fill + o.n > 100)::INTEGER, CASE WHEN f.fill > 0 AND f.fill + o.n > 100 THEN 0 ELSE f.fill END, CASE WHEN f.fill > 0 AND f.fill + o.n > 100 THEN o.n ELSE f.fill + o.n END
  FROM fold f JOIN o ON o.type = f.type AND o.k = f.k + 1)
SELECT type, batch::INTEGER AS batch, "group", first FROM fold""")
def entity_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return R.make_batches(numbered(g, [F.asc("type"), F.asc("name")], "group", 1).select("type", "group", "n"))


@query(f"""WITH {KEYED}, {NORM} SELECT 'b_' || (form_id // 100) AS batch_id, string_agg((form_id % 100 + 1) || '. ' || alias_key || ' | ' || top_surface, chr(10) ORDER BY form_id) AS prompt FROM norm GROUP BY 1""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Dictionary.read(spark, sf_dir).norm
    batch = F.concat(F.lit("b_"), F.floor(F.col("form_id") / 100).cast("string"))
    return R.prompts(n.select(batch.alias("batch_id"), (F.col("form_id") % 100 + 1).alias("index"), "alias_key", F.col("top_surface").alias("sample_title")))


#: Ten parts to a batch; answers follow one of four patterns by the batch's number: two that can be read, one that can't, none.
READABLE = {0: ([[1, 2], [2, 3], [11]], [0.9, 0.5, 0.1]), 2: ([[1, 3, 5], [2, 4], [6, 7, 8, 9, 10], [4]], [0.8, 0.7, 0.6])}
_SAID = ", ".join(f"({k}, {n}, {pos}, {i}, {conf[n] if n < len(conf) else 'NULL'})" for k, (groups, conf) in READABLE.items() for n, g in enumerate(groups) for pos, i in enumerate(g))
ANSWERED = f"""forms AS (SELECT 'b' || (p_partkey // 10) AS batch_id, (p_partkey // 10) % 4 AS k, p_partkey % 10 + 1 AS index, p_partkey AS form_id, p_size % 3 AS group_of FROM part),
said AS (SELECT DISTINCT batch_id, number, pos, s.index, confidence FROM forms f JOIN (VALUES {_SAID}) s(k, number, pos, index, confidence) ON s.k = f.k),
real AS (SELECT s.*, form_id, group_of FROM said s JOIN forms USING (batch_id, index)), wide AS (SELECT batch_id, number, count(DISTINCT index) AS width FROM real GROUP BY ALL),
ranked AS (SELECT r.*, count(*) OVER (PARTITION BY batch_id, index) AS times, row_number() OVER (PARTITION BY batch_id, index ORDER BY width, number, pos) AS r FROM real r JOIN wide USING (batch_id, number)),
owned AS (SELECT * FROM ranked WHERE r = 1), mixed AS (SELECT batch_id, number FROM owned GROUP BY ALL HAVING count(DISTINCT group_of) > 1)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    number = F.floor(F.col("p_partkey") / 10)
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), number.cast("string")).alias("batch_id"),
        (number % 4).alias("k"),
        (F.col("p_partkey") % 10 + 1).alias("index"),
        F.col("p_partkey").alias("form_id"),
        (F.col("p_size") % 3).alias("group_of"),
    )
    raw = F.lit("not json")
    for k, (groups, confidence) in READABLE.items():
        raw = F.when(F.col("k") == k, F.lit(json.dumps({"groups": groups, "confidence": confidence}))).otherwise(raw)
    return p.where("k <> 3").select("batch_id", "k").distinct().select("batch_id", raw.alias("raw")), p.drop("k")


@query(f"""WITH {ANSWERED} SELECT batch_id, index::BIGINT AS index, NULL::BIGINT AS form_id, 'invented' AS reason FROM said LEFT JOIN forms USING (batch_id, index) WHERE form_id IS NULL
UNION ALL SELECT batch_id, index, form_id, 'duplicate' FROM owned WHERE times > 1 UNION ALL SELECT batch_id, index, form_id, 'cross_group' FROM owned JOIN mixed USING (batch_id, number)
UNION ALL SELECT batch_id, index, form_id, 'lost' FROM forms f WHERE k IN (0, 2) AND form_id NOT IN (SELECT form_id FROM owned) UNION ALL SELECT DISTINCT batch_id, NULL, NULL, 'invalid_json' FROM forms WHERE k = 1""")
def answer_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_answers(*_answers(spark, sf_dir))[1]


@query(f"""WITH {ANSWERED} SELECT batch_id, form_id, min(form_id) OVER (PARTITION BY batch_id, number, group_of) AS part, confidence::DOUBLE AS confidence FROM owned
UNION ALL SELECT batch_id, form_id, form_id, NULL FROM forms WHERE form_id NOT IN (SELECT form_id FROM owned)""")
def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_answers(*_answers(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {CLUSTERS} SELECT form_id, cluster, method FROM meth")
def form_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dictionary.read(spark, sf_dir).clustered().norm.select("form_id", "cluster", "method")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT entity_id, canonical, type, n_mentions FROM ids")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dictionary.read(spark, sf_dir).clustered().entity_ids().select("entity_id", "canonical", "type", "n_mentions")


ENTITY = f"{CLUSTERS}, em AS (SELECT k.*, i.entity_id, m.type_ambiguous FROM keyed k JOIN meth m USING (alias_key) JOIN ids i ON i.cluster = m.cluster)"
#: Stand-in for what a model's answers leave on forms: the confidence of groups of several forms, and vetoes.
JUDGED = {"group_confidence": "CASE WHEN aliases > 1 THEN (form_id % 10 + 1) / CAST(10.0 AS DOUBLE) END", "veto_applied": "form_id % 7 = 0"}


@query(f"""WITH RECURSIVE {ENTITY}, counts AS (SELECT entity_id, count(*) AS n_mentions, count(DISTINCT article_id) AS n_docs, count(DISTINCT story_id) AS n_stories, count(DISTINCT source) AS n_sources, min(date) AS first_seen, max(date) AS last_seen,
  bool_or(type_ambiguous) AS ambiguous, {", ".join(f"count(*) FILTER (sentiment = '{s}')::DOUBLE / count(*) AS {s}" for s in M.SENTIMENTS)}, {", ".join(f"count(*) FILTER (role = '{r}')::DOUBLE / count(*) AS {r}" for r in M.ROLES)} FROM em GROUP BY entity_id),
names AS (SELECT entity_id, name, max(f.n_mentions) AS n FROM forms f JOIN meth m USING (alias_key) JOIN ids i ON i.cluster = m.cluster GROUP BY ALL),
al AS (SELECT entity_id, string_agg(name, '|' ORDER BY n DESC, name) AS aliases, count(*) AS n_aliases FROM names GROUP BY 1),
me AS (SELECT entity_id, count(*) FILTER (method = 'rule') AS rule, count(*) FILTER (method = 'llm') AS llm, count(*) FILTER (method = 'singleton') AS singleton FROM forms f JOIN meth m USING (alias_key) JOIN ids i ON i.cluster = m.cluster GROUP BY 1),
ju AS (SELECT entity_id, min({JUDGED["group_confidence"]}) AS min_confidence, count(*) FILTER ({JUDGED["veto_applied"]}) AS n_veto_splits FROM (SELECT m.*, count(*) OVER (PARTITION BY cluster) AS aliases FROM meth m) m JOIN (SELECT cluster, entity_id FROM ids) i USING (cluster) GROUP BY 1)
SELECT c.*, canonical, type, aliases, n_aliases, rule, llm, singleton, min_confidence, n_veto_splits FROM counts c JOIN al USING (entity_id) JOIN me USING (entity_id) JOIN ju USING (entity_id) JOIN (SELECT entity_id, canonical, type FROM ids) USING (entity_id)""")
def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dictionary.read(spark, sf_dir).clustered()
    ids = settle(d.entity_ids())
    norm = d.norm.join(ids.select("cluster", "entity_id"), "cluster")
    for name, rule in JUDGED.items():
        norm = norm.withColumn(name, F.expr(rule))
    out = M.entities(d.keyed.join(norm.select("alias_key", "entity_id", "type_ambiguous"), "alias_key"))
    out = out.join(M.entity_forms(d.forms.join(norm.select("alias_key", "entity_id", "method"), "alias_key")), "entity_id").join(M.entity_judgements(norm), "entity_id")
    wide = out.join(ids.select("entity_id", "canonical", "type"), "entity_id").withColumn("aliases", F.array_join("aliases", "|"))
    return wide.select("*", "sentiment_dist.*", "top_roles.*", "methods.*").drop("sentiment_dist", "top_roles", "methods")


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT entity_id, count(*) FILTER (method = 'rule') AS rule, count(*) FILTER (method = 'llm') AS llm, count(*) FILTER (method = 'singleton') AS singleton
FROM forms f JOIN meth m USING (alias_key) JOIN ids i ON i.cluster = m.cluster GROUP BY entity_id""")
def entity_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dictionary.read(spark, sf_dir).clustered()
    return M.method_counts(d.forms.select("alias_key").join(d.norm.select("alias_key", "cluster", "method"), "alias_key").join(d.entity_ids().select("cluster", "entity_id"), "cluster"))


@query(f"""WITH RECURSIVE {CLUSTERS}, x AS (SELECT type, 0 AS k FROM forms UNION ALL SELECT type, 1 FROM norm UNION ALL SELECT type, 2 FROM ids)
SELECT CASE WHEN grouping(type) = 1 THEN 'TOTAL' ELSE type END AS type, count(*) FILTER (k = 0) AS surface_forms, count(*) FILTER (k = 1) AS normalized_forms, count(*) FILTER (k = 2) AS entities,
count(*) FILTER (k = 0)::DOUBLE / greatest(count(*) FILTER (k = 2), 1) AS surface_to_entities FROM x GROUP BY ROLLUP (type)""")
def dictionary_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dictionary.read(spark, sf_dir).clustered()
    return M.compression(d.forms, d.norm, d.entity_ids())


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT k.article_id, string_agg(k.name || '>' || i.entity_id, ',' ORDER BY k.l_linenumber, k.l_extendedprice, k.name, k.type) AS linked FROM keyed k JOIN meth m USING (alias_key) JOIN ids i ON i.cluster = m.cluster GROUP BY 1""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dictionary.read(spark, sf_dir).clustered()
    ids = d.entity_ids().select("cluster", "entity_id", "canonical")
    lookup = d.forms.select("name", "type", "alias_key").join(d.norm.select("alias_key", "cluster", "method"), "alias_key").join(ids, "cluster")
    entity = F.struct("l_linenumber", "l_extendedprice", "name", "type", "role", "sentiment")
    docs = d.keyed.groupBy("article_id").agg(F.sort_array(F.collect_list(entity)).alias("entities"))
    out = M.link(docs, lookup)
    return out.select("article_id", F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(">"), e["entity_id"])), ",").alias("linked"))


@query(f"""WITH RECURSIVE {CLUSTERS}, sizes_ AS (SELECT cluster, count(*) AS n FROM meth GROUP BY 1)
SELECT (SELECT count(*) FROM forms) AS surface_forms, (SELECT count(*) FROM norm) AS normalized_forms, (SELECT count(*) FROM ids) AS entities, (SELECT count(*) FROM vp) AS merge_pairs, (SELECT count(*) FROM norm WHERE active) AS active_forms,
  (SELECT count(*) FROM norm WHERE NOT active) AS tail_forms, (SELECT count(*) FROM norm WHERE type_ambiguous) AS type_ambiguous_forms, (SELECT count(*) FROM sizes_ WHERE n > 1) AS entities_merged_by_llm""")
def linking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dictionary.read(spark, sf_dir)
    votes, merged = d.votes(), d.clustered()
    figures = d.norm.agg(F.count("*").alias("normalized_forms"), F.count_if("active").alias("active_forms"), F.count_if(~F.col("active")).alias("tail_forms"), F.count_if("type_ambiguous").alias("type_ambiguous_forms"))
    more = [
        d.forms.agg(F.count("*").alias("surface_forms")),
        votes.agg(F.count("*").alias("merge_pairs")),
        merged.norm.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("entities_merged_by_llm")),
    ]
    for part in more:
        figures = figures.crossJoin(F.broadcast(part))  # one row each
    return figures
