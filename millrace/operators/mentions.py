"""Entity mentions: explosion, surface forms, alias dictionary, candidate edges, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import settle
from .order import numbered

SENTIMENTS = ("pos", "neu", "neg", "unknown")
ROLES = ("actor", "object", "mentioned")
METHODS = ("rule", "llm", "singleton")
PREFIX = {"ORG": "org", "PER": "per", "LOC": "loc", "GPE": "gpe", "PRODUCT": "prod", "EVENT": "event"}


def explode_mentions(docs: DataFrame) -> DataFrame:
    """One row per entity of each document (article_id, story_id, date, source, confidence, text, entities)."""
    e = docs.select("article_id", "story_id", "date", "source", "confidence", "text", F.explode("entities").alias("e"))
    grounded = F.coalesce(F.contains(F.col("text"), F.col("e.name")), F.lit(False))
    return e.select("article_id", "story_id", "date", "source", "e.name", "e.type", "e.role", "e.sentiment", "confidence", grounded.alias("grounded"), F.col("e.normalized_id").alias("normalized_llm"))


def surface_forms(mentions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, first and last day and mean confidence of each (name, type)."""
    return mentions.groupBy(*(keys or ["name", "type"])).agg(
        F.count("*").alias("n_mentions"),
        F.count_distinct("article_id").alias("n_docs"),
        F.count_distinct("story_id").alias("n_stories"),
        F.count_distinct("source").alias("n_sources"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.avg("confidence").alias("conf_mean"),
    )


def normalization_mode(mentions: DataFrame, key: str) -> DataFrame:
    """(key, normalized_llm, llm_norm_agree): the most frequent normalisation, ties to the smaller, over all mentions of the key."""
    counts = mentions.groupBy(key, "normalized_llm").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    best = F.row_number().over(w.orderBy(F.col("normalized_llm").isNull(), F.desc("n"), "normalized_llm"))
    agree = F.col("n").cast("double") / F.sum("n").over(w).cast("double")
    return counts.withColumn("llm_norm_agree", agree).withColumn("r", best).where("r = 1 AND normalized_llm IS NOT NULL").select(key, "normalized_llm", "llm_norm_agree")


def sample_titles(mentions: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """(key, sample_title) from the article of the largest story that has the key, ties to the smaller id."""
    sized = mentions.select(key, "article_id").join(articles.select("article_id", "title", "story_size"), "article_id", "left")
    return sized.groupBy(key).agg(F.max_by("title", F.struct(F.coalesce("story_size", F.lit(0)), -F.col("article_id"))).alias("sample_title"))


def alias_types(forms: DataFrame, ambiguous_share: float = 0.2) -> DataFrame:
    """(alias_key, type, type_ambiguous): main type by mentions, ties to the smaller name."""
    by = forms.groupBy("alias_key", "type").agg(F.sum("n_mentions").alias("n"))
    w = Window.partitionBy("alias_key")
    ranked = by.withColumn("share", F.col("n").cast("double") / F.sum("n").over(w).cast("double")).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "type")))
    return ranked.groupBy("alias_key").agg(F.max(F.when(F.col("r") == 1, F.col("type"))).alias("type"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("share") >= ambiguous_share)), F.lit(False)).alias("type_ambiguous"))


def variants(forms: DataFrame, key: str) -> DataFrame:
    """(key, variants, top_surface): distinct names by falling mentions, ties to the smaller name."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n_mentions")).alias("n"), "name")))
    out = forms.groupBy(key).agg(F.array_distinct(F.transform(order, lambda x: x["name"])).alias("variants"))
    return out.withColumn("top_surface", F.get("variants", F.lit(0)))


def alias_dictionary(forms: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row per alias_key with form_id, numbered by falling stories and mentions, then key.

    ``forms`` has name, type, n_mentions, alias_key; ``mentions`` alias_key, story_id, article_id,
    normalized_llm. Active keys have two stories or more and aren't junk.
    """
    counts = mentions.groupBy("alias_key").agg(F.count_distinct("story_id").alias("n_stories"), F.count("*").alias("n_mentions"))
    out = counts.join(alias_types(forms), "alias_key").join(variants(forms, "alias_key"), "alias_key").join(normalization_mode(mentions, "alias_key"), "alias_key", "left")
    out = out.withColumn("active", (F.col("n_stories") > 1) & ~X.is_junk_alias(F.col("alias_key")))
    return numbered(out, [F.desc("n_stories"), F.desc("n_mentions"), F.asc("alias_key")], "form_id")


def vote_pairs(active: DataFrame, max_group: int = 20, clean=None) -> DataFrame:
    """(a, b) of forms of one type that share a key, their own or their cleaned normalisation.

    Groups of up to ``max_group`` give all pairs, larger ones a star around the least form.
    """
    clean = clean or (lambda name, kind: X.clean_form(name, kind))
    own = active.select("type", F.col("alias_key").alias("key"), "form_id")
    said = active.where(F.trim("normalized_llm") != "").select("type", clean(F.col("normalized_llm"), F.col("type")).alias("key"), "form_id")
    votes = settle(own.unionByName(said).distinct())
    sized = votes.join(votes.groupBy("type", "key").agg(F.count("*").alias("n"), F.min("form_id").alias("least")).where("n > 1"), ["type", "key"])
    small = sized.where(F.col("n") <= max_group)
    cliques = small.select("type", "key", F.col("form_id").alias("a")).join(small.select("type", "key", F.col("form_id").alias("b")), ["type", "key"]).where("a < b").select("a", "b")
    stars = sized.where((F.col("n") > max_group) & (F.col("form_id") > F.col("least"))).select(F.col("least").alias("a"), F.col("form_id").alias("b"))
    return cliques.unionByName(stars).distinct()


def merge_edges(emb: DataFrame, votes: DataFrame) -> DataFrame:
    """(a, b, channels sorted, score): edges of both channels; a pure vote has no score."""
    both = emb.select("a", "b", F.lit("emb").alias("channel"), "score").unionByName(votes.select("a", "b", F.lit("llm_vote").alias("channel"), F.lit(None).cast("double").alias("score")))
    return both.groupBy("a", "b").agg(F.sort_array(F.collect_set("channel")).alias("channels"), F.max("score").alias("score"))


def drop_geo_conflicts(edges: DataFrame, forms: DataFrame, places: DataFrame, marker=None) -> DataFrame:
    """Edges without those between two organisations of different geographic qualifiers.

    ``forms`` has form_id, type, alias_key; ``places`` alias_key, one place word each. Only a
    form's own words can be places in it, so words are joined with places, not places collected.
    """
    marker = marker or X.geo_marker
    orgs = forms.where("type = 'ORG'").select("form_id", "alias_key")
    words = orgs.select("form_id", F.explode(F.split("alias_key", " ")).alias("word")).join(places.select(F.col("alias_key").alias("word")).distinct(), "word")
    own = words.groupBy("form_id").agg(F.collect_set("word").alias("places"))
    marked = orgs.join(own, "form_id", "left").select("form_id", marker(F.col("alias_key"), F.coalesce("places", F.array().cast("array<string>"))).alias("m"))
    out = edges.join(marked.select(F.col("form_id").alias("a"), F.col("m").alias("ma")), "a", "left").join(marked.select(F.col("form_id").alias("b"), F.col("m").alias("mb")), "b", "left")
    return out.where("ma IS NULL OR mb IS NULL OR ma = mb").select("a", "b", "channels", "score")


def gazetteer(forms: DataFrame, min_stories: int = 100, shortest: int = 3) -> DataFrame:
    """(alias_key) of active one-word places that ``min_stories`` stories have."""
    place = F.col("type").isin("LOC", "GPE") & F.col("active") & (F.col("n_stories") >= min_stories)
    word = ~F.contains(F.col("alias_key"), F.lit(" ")) & (F.length("alias_key") >= shortest) & ~F.col("alias_key").isin(*X.NEUTRAL_PLACES)
    return forms.where(place & word).select("alias_key")


def method_of(forms_per_cluster: Column, surfaces: Column) -> Column:
    return F.when(forms_per_cluster > 1, "llm").when(surfaces > 1, "rule").otherwise("singleton")


def shares_of(column: str, values: tuple[str, ...]) -> Column:
    """Struct of the share of each value among a group's rows."""
    known = F.count(column).cast("double")
    return F.struct(*[(F.count_if(F.col(column) == v).cast("double") / F.nullif(known, F.lit(0.0))).alias(v) for v in values])


def number_entities(clusters: DataFrame) -> DataFrame:
    """Adds entity_id: prefix of the type and the number within it by falling mentions, then canonical name, then cluster.

    Numbers come from global places less the first place of the type, so no type is one task.
    """
    prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[F.col("type")], F.lower("type"))
    placed = settle(numbered(clusters, [F.asc("type"), F.desc("n_mentions"), F.asc("canonical"), F.asc("cluster")], "__place"))
    firsts = placed.groupBy("type").agg(F.min("__place").alias("__first"))
    number = (F.col("__place") - F.col("__first") + 1).cast("string")
    return placed.join(firsts, "type").withColumn("entity_id", F.concat(prefix, F.lit("_"), F.lpad(number, 6, "0"))).drop("__place", "__first")


def entities(mentions: DataFrame) -> DataFrame:
    """One row per entity_id: counts, days, shares of sentiments and roles, ambiguity."""
    return mentions.groupBy("entity_id").agg(
        F.count("*").alias("n_mentions"),
        F.count_distinct("article_id").alias("n_docs"),
        F.count_distinct("story_id").alias("n_stories"),
        F.count_distinct("source").alias("n_sources"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        shares_of("sentiment", SENTIMENTS).alias("sentiment_dist"),
        shares_of("role", ROLES).alias("top_roles"),
        F.bool_or("type_ambiguous").alias("ambiguous"),
    )


def method_counts(forms: DataFrame) -> DataFrame:
    """(entity_id, rule, llm, singleton): forms by how they were merged."""
    return forms.groupBy("entity_id").agg(*[F.count_if(F.col("method") == m).alias(m) for m in METHODS])


def entity_forms(forms: DataFrame) -> DataFrame:
    """(entity_id, aliases, n_aliases, methods): names by falling mentions, ties to the smaller, and forms by method.

    ``forms`` has entity_id, name, n_mentions, method; a name counts once, with its most frequent form.
    """
    methods = F.struct(*[F.count_if(F.col("method") == m).alias(m) for m in METHODS]).alias("methods")
    names = forms.groupBy("entity_id", "name").agg(F.max("n_mentions").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name")))
    listed = names.groupBy("entity_id").agg(F.transform(order, lambda x: x["name"]).alias("aliases"), F.count("*").alias("n_aliases"))
    return listed.join(forms.groupBy("entity_id").agg(methods), "entity_id")


def entity_judgements(norm: DataFrame) -> DataFrame:
    """(entity_id, min_confidence, n_veto_splits): the least confidence of accepted groups of several forms, and vetoed forms.

    ``norm`` has entity_id, group_confidence (null for forms that stand alone), veto_applied.
    """
    return norm.groupBy("entity_id").agg(F.min("group_confidence").alias("min_confidence"), F.count_if(F.col("veto_applied")).alias("n_veto_splits"))


def compression(forms: DataFrame, norm: DataFrame, entity: DataFrame) -> DataFrame:
    """(type, surface_forms, normalized_forms, entities, surface_to_entities) by type, and a TOTAL row."""
    tagged = [d.select("type", F.lit(k).alias("k")) for k, d in enumerate((forms, norm, entity))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    counts = rows.rollup("type").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in enumerate(("surface_forms", "normalized_forms", "entities"))], F.grouping("type").alias("g"))
    named = counts.withColumn("type", F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("type")))
    rate = F.col("surface_forms").cast("double") / F.greatest(F.col("entities"), F.lit(1)).cast("double")
    return named.select("type", "surface_forms", "normalized_forms", "entities", rate.alias("surface_to_entities"))


def canonical_names(forms: DataFrame, norm: DataFrame) -> DataFrame:
    """(cluster, canonical): most frequent surface that is already in its simple form, else the root's
    normalisation, else its top surface. ``norm`` has form_id, cluster, normalized_llm, top_surface."""
    nominative = forms.where(X.simple_form(F.col("name")) == F.col("alias_key")).groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("n_mentions"), "name")).alias("first"))
    roots = norm.where("form_id = cluster").select("cluster", "normalized_llm", "top_surface")
    return roots.join(nominative, "cluster", "left").select("cluster", F.coalesce("first", "normalized_llm", "top_surface").alias("canonical"))


def link(docs: DataFrame, lookup: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``docs`` (id, entities) with each entity struct widened by its link fields, order kept.

    ``lookup`` has name, type, alias_key, entity_id, canonical, method; unknown entities get nulls.
    """
    fields = ["alias_key", "entity_id", "canonical", "method"]
    each = docs.select(id_col, F.posexplode_outer("entities").alias("pos", "e"))
    known = each.join(lookup.select(F.col("name").alias("n"), F.col("type").alias("t"), *fields), (F.col("e.name") == F.col("n")) & (F.col("e.type") == F.col("t")), "left")
    wide = F.struct("e.*", *fields)
    back = known.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", wide.alias("x"))))).alias("l"))
    return docs.drop("entities").join(back.select(id_col, F.transform("l", lambda x: x["x"]).alias("entities")), id_col)


def channel_contribution(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(channel, pairs): accepted pairs by the channel that proposed them; transitive if none did."""
    label = F.when(F.col("channels").isNull(), "transitive").when(F.size("channels") == 2, "both").otherwise(F.get("channels", F.lit(0)))
    return pairs.join(edges.select("a", "b", "channels"), ["a", "b"], "left").groupBy(label.alias("channel")).agg(F.count("*").alias("pairs"))


