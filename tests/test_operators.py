"""Operators on small frames worked out by hand or by a plain second implementation."""

import html
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import bursts as B
from millrace.operators import clean as C
from millrace.operators import dedup as D
from millrace.operators import enrichment as E
from millrace.operators import mentions as M
from millrace.operators import network as N
from millrace.operators import resolve as R
from millrace.operators import series as S
from millrace.operators import stories as T
from millrace.operators import topics as P
from millrace.operators.graph import connected_components
from millrace.operators.skew import join_counted


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


# --- text


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a &amp; b", "a & b"),
        ("<p>Да</p>  нет .", "Да нет."),
        ("см. https://a.b/c?d и www.x.ru тут", "см. и тут"),
        ("“раз” ‘два’ \"три\"", "«раз» 'два' «три»"),
        ("раз - два – три -- ок", "раз — два — три — ок"),
        ("№ 5 ﬁ­​", "№ 5 fi"),
        (None, None),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, X.normalize(F.col("t")), t=raw) == clean


def test_unescape_agrees_with_python(spark):
    for s in ("&lt;b&gt; &nbsp;x", "ﬀ ① ½", "№№"):
        want = "№".join(unicodedata.normalize("NFKC", p) for p in html.unescape(s).split("№"))
        assert one(spark, X._unescape_nfkc(F.col("t")), t=s) == want


def test_sentences(spark):
    got = one(spark, X.sentences(F.col("t")), t="В 2016 г. Иван сказал. Потом ушёл! А. С. Пушкин жил на ул. Мира. «Да» — ответил он")
    assert got == ["В 2016 г. Иван сказал.", "Потом ушёл!", "А. С. Пушкин жил на ул. Мира.", "«Да» — ответил он"]


def test_drop_junk(spark):
    text = "Первое предложение. Подписывайтесь на нас! Первое, предложение! Реклама тут. Второе. Лента.ру"
    got = one(spark, X.drop_junk(F.col("t"), X.sentences(F.col("t")), F.array(F.lit("реклама тут"))), t=text)
    assert got == "Первое предложение. Второе."


def test_names(spark):
    assert one(spark, X.clean_form(F.col("n"), F.lit("ORG")), n="ООО «Ромашка»") == "ромашка"
    assert one(spark, X.clean_form(F.col("n"), F.lit("ORG")), n="ООО") == "ооо"
    assert one(spark, X.clean_form(F.col("n"), F.lit("PER")), n="Пётр (Первый),") == "петр первый"
    lemma = lambda w: F.concat(w, F.lit("_"))
    assert one(spark, X.clean_form(F.col("n"), F.lit("ORG"), lemma), n="МЧС России IT-отдел abc") == "мчс россии_ it-отдел abc"
    for key, junk in (("5 %", True), ("20-летний", True), ("12, 5", True), ("5 канал", False), ("канал 5", False)):
        assert one(spark, X.is_junk_alias(F.col("k")), k=key) is junk
    assert one(spark, X.shingles(X.words(F.col("t"))), t="a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, X.shingles(X.words(F.col("t"))), t="a b") == [] and one(spark, X.words(F.col("t")), t=" ,. ") == []


def test_checks(spark):
    rows = [("2016-01-01", "Заголовок статьи", "слово " * 50), (None, "короткий", "x"), ("2016-01-01", "Заголовок статьи", "word " * 50), ("2016-01-01", None, None), ("2016-01-01", "Заголовок статьи", "1" * 300)]
    df = C.flagged(spark.createDataFrame(rows, "dt_utc string, title string, text string"))
    clean, rejected = C.split(df)
    assert clean.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["low_letter_share;not_ru", "no_date;no_title;short_text;not_ru", "no_title;short_text;low_letter_share;not_ru", "not_ru"]


# --- duplicates and stories


def test_near_pairs_lose_none(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    rows = []
    for i in range(80):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, " ".join(t)))
    got = {(r.a, r.b): round(r.score, 9) for r in D.near_pairs(D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    firsts = {}
    for i, t in rows:
        firsts.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t, i in firsts.items()}
    want = {}
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.8:
            want[a, b] = round(j, 9)
    assert got == want and want
    lsh = D.lsh_pairs(D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r.a, r.b) for r in lsh.collect()} <= set(want)


def test_near_pairs_join_prefixes_alone(spark, monkeypatch):
    """Texts of words of their own share no key; of near copies only the prefixes, a fifth of their sets, are joined, and frequent lines come last."""
    rng, line = random.Random(8), " ".join(f"l{k}" for k in range(30))
    rows = [(i, " ".join(f"{i // 2}_{k}" for k in range(100)) + " " + line + (" end" if i % 2 else "")) for i in range(60)]
    sets = D.shingle_sets(spark.createDataFrame(rows + [(i + 100, rng.choice(rows)[1]) for i in range(20)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in sets.collect()) == list(range(60))
    asked = []
    verified = D._verified
    monkeypatch.setattr(D, "_verified", lambda candidates, *more: asked.append(candidates) or verified(candidates, *more))
    pairs = {(r.a, r.b) for r in D.near_pairs(sets).collect()}
    assert pairs == {(i, i + 1) for i in range(0, 60, 2)} == {(r.a, r.b) for r in asked[0].collect()}
    assert {(r.a, r.b) for r in D.lsh_pairs(sets).collect()} == pairs


@pytest.mark.parametrize(("cell", "most"), [(512, 2_000_000), (8, 1), (8, 300)])
def test_near_copies_move_once_for_a_cell(spark, monkeypatch, cell, most):
    """The set of each of k near copies is sent to a few cells, not to each of its k - 1 partners, and no pair is lost."""
    monkeypatch.setattr(D, "CELL_SETS", cell)
    monkeypatch.setattr(D, "MEET_VALUES", most)
    text = [f"w{k}" for k in range(60)]
    rows = [(f"d{i:02}", " ".join([*text, f"end{i}"])) for i in range(40)] + [(f"e{i}", " ".join(f"{i // 2}x{k}" for k in range(50 + i % 2))) for i in range(10)]
    sets = D.shingle_sets(spark.createDataFrame(rows, "doc_id string, text string"))
    asked = []
    cells = D._cells
    monkeypatch.setattr(D, "_cells", lambda candidates: asked.append(candidates) or cells(candidates))
    pairs = {(r.a, r.b): r.score for r in D.near_pairs(sets).collect()}
    want = {(f"d{i:02}", f"d{j:02}"): 56 / 58 for i in range(40) for j in range(i + 1, 40)} | {(f"e{i}", f"e{i + 1}"): 46 / 47 for i in range(0, 10, 2)}
    assert pairs == pytest.approx(want)
    placed = cells(asked[0]).collect()
    assert {(r.a, r.b) for r in placed} == set(want) and len(placed) == len(want)
    moved = {(r.cell, x) for r in placed for x in (r.a, r.b)}
    assert len(moved) <= (50 if cell == 512 else 50 * 2 * 10) < 2 * len(want)
    assert max(sum(c == k for c, _ in moved) for k in {c for c, _ in moved}) <= (40 if cell == 512 else 25)


def test_lsh_finds_pairs_near_the_threshold(spark):
    rng, rows = random.Random(3), []
    for i in range(0, 120, 2):
        words = [f"{i}_{k}" for k in range(120)]
        changed = list(words)
        for at in rng.sample(range(5, 115, 12), 2):
            changed[at] = f"x{i}_{at}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(changed))]
    sets = D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    near = {(r.a, r.b): r.score for r in D.near_pairs(sets).collect()}
    assert len(near) == 60 and max(near.values()) < 0.87
    assert {(r.a, r.b): r.score for r in D.lsh_pairs(sets).collect()} == near


def test_components_of_a_long_path(spark):
    order = list(range(5000))
    random.Random(4).shuffle(order)
    path = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    found = connected_components(path).collect()
    assert len(found) == 5000 and {r.component for r in found} == {0}


def test_join_counted_is_a_join(spark):
    rng = random.Random(6)
    keys = [0] * 4000 + [rng.randrange(1, 3000) for _ in range(3000)] + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("size"), F.min("i").alias("first"))
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    got = {r.i: r["first"] for r in join_counted(rows, groups, "k").collect()}
    assert got == {i: first[k] for i, k in enumerate(keys) if k is not None}
    assert join_counted(rows.limit(0), groups.limit(0), "k").count() == 0


def test_components_and_chain_split(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in range(40):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(table).collect()} == label
    odd = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "src long, dst long")
    assert [tuple(r) for r in connected_components(odd).collect()] == [(3, 3)]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1, "semantic", 0.905) for i in range(60)], "a long, b long, level string, score double")
    assert T.split_stories(chain).select("component").distinct().count() == 61
    held = spark.createDataFrame([(i, i + 1, "minhash", 0.905) for i in range(60)], "a long, b long, level string, score double")
    assert T.split_stories(held).select("component").distinct().count() == 1


def test_canonical(spark):
    rows = [(0, "s", 5, 10), (1, "s", 5, 20), (2, "t", 7, 90)]
    articles = spark.createDataFrame(rows, "row long, source string, dt long, text_len long")
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node long, component long")
    for rule, row in (("earliest", 1), ("longest", 2)):
        got = T.story_map(articles, parts, rule).where("is_canonical").collect()
        assert [r.row for r in got] == [row] and got[0].story_id == "s_000000" and got[0].story_size == 3


def test_band_pairs_over_many_blocks(spark):
    rng = np.random.default_rng(9)
    n, day = 400, 86_400
    base = rng.normal(size=(6, 8))
    v = base[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    t = np.where(rng.random(n) < 0.4, 10 * day, rng.integers(0, 20 * day, n))
    rows = [(i, int(t[i]), v[i].tolist()) for i in range(n)]
    odd = [(900, None, rows[0][2]), (None, 5, rows[0][2]), (901, 5, None), (902, 5, [1.0]), (903, 5, [None] * 8), (904, 5, [])]
    table = spark.createDataFrame(rows + odd, "id long, t long, v array<double>").select("id", F.timestamp_seconds("t").alias("ts"), "v")
    want = {}
    for i in range(n):
        for j in range(n):
            if (t[i], i) < (t[j], j) and t[j] - t[i] <= 3 * day and v[i] @ v[j] >= 0.9:
                want[i, j] = v[i] @ v[j]
    got = D.band_pairs(table, 0.9, 3, block=40).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == pytest.approx(want)
    assert D.band_pairs(table.limit(0)).count() == 0


def test_band_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 20)) * 43_200, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t long, v array<double>").select("id", F.timestamp_seconds("t").alias("ts"), "v")
    got = {(r.a, r.b) for r in D.band_pairs(df, threshold=1.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if ((a[1], a[0]) < (b[1], b[0])) and b[1] - a[1] <= 259_200 and np.dot(a[2], b[2]) >= 1.0}
    assert got == want and want


# --- series and bursts


def viterbi(r, d, s, gamma):
    n, p0 = len(r), sum(r) / sum(d)
    p = (p0, min(s * p0, 0.9999))
    cost = [[-(a * math.log(q) + (b - a) * math.log(1 - q)) for a, b in zip(r, d)] for q in p]
    best = None
    for path in itertools.product((0, 1), repeat=n):
        c = sum(cost[x][t] for t, x in enumerate(path)) + gamma * math.log(n) * sum(b > a for a, b in zip((0, *path), path))
        if best is None or c < best[0] - 1e-12:
            best = (c, path)
    return best[1]


@pytest.mark.parametrize(("r", "d"), [([1, 1, 1, 9, 9, 1, 1], [20] * 7), ([0, 5, 0, 0, 6, 7, 0, 1], [10, 12, 9, 9, 10, 11, 10, 9]), ([3], [5])])
def test_bursts(spark, r, d):
    rows = [("k", "x", f"2024-01-{i + 1:02d}", a, b, None, False) for i, (a, b) in enumerate(zip(r, d))]
    series = spark.createDataFrame(rows, "kind string, key string, date string, stories long, day_total long, z double, z_outlier boolean").withColumn("date", F.to_date("date"))
    states = [x.state for x in B.burst_states(series, 2.0, 1.0).orderBy("date").collect()]
    assert tuple(states) == viterbi(r, d, 2.0, 1.0)
    found = B.bursts(series, 2.0, 1.0).collect()
    assert sum(x.days for x in found) == sum(states)


def test_zones(spark):
    wall = spark.sql("SELECT TIMESTAMP '2016-03-27 02:30:00' AS gap, TIMESTAMP '2016-10-30 02:30:00' AS twice, TIMESTAMP '2016-07-01 12:00:00' AS plain")
    got = wall.select(*[S.utc_instant(F.col(c), "Europe/Berlin").cast("string").alias(c) for c in ("gap", "twice", "plain")]).first()
    assert (got.gap, got.twice, got.plain) == (None, None, "2016-07-01 10:00:00")
    assert one(spark, S.parse_time(F.col("t")).cast("string"), t="2016-02-30 10:00:00") is None
    assert one(spark, S.parse_time(F.col("t")).cast("string"), t="2016-02-28") == "2016-02-28 00:00:00"


# --- network


@pytest.fixture(scope="module")
def cliques(spark):
    """Two cliques of four joined by one edge."""
    edges = [(a, b, 1, 2.0) for g in ("abcd", "efgh") for a, b in itertools.combinations(g, 2)] + [("d", "e", 1, 1.0)]
    return spark.createDataFrame(edges, "a string, b string, n_stories long, pmi double")


def test_network(spark, cliques):
    groups = {r.node: r.community for r in N.louvain(cliques).collect()}
    assert {groups[x] for x in "abcd"} == {0} and {groups[x] for x in "efgh"} == {1}
    member = spark.createDataFrame(list(groups.items()), "node string, community long")
    assert N.modularity(cliques, member).first().modularity > 0.4
    ranks = {r.node: r.pagerank for r in N.pagerank(cliques).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) in "de"
    between = {r.node: r.betweenness for r in N.betweenness(cliques).collect()}
    # d lies on the shortest paths of a, b, c to e, f, g, h: 12 of 21 pairs without d
    assert between["d"] == pytest.approx(12 / 21) and between["a"] == 0
    sampled = {r.node: r.betweenness for r in N.betweenness(cliques, exact_up_to=2, sources=8).collect()}
    assert sampled == pytest.approx(between)


def test_months_are_graphs_of_their_own(spark):
    rng = random.Random(5)
    rows = [(m, a, b, 1, 0.5 + rng.random()) for m in ("2024-01", "2024-02", "2024-03") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25]
    edges = spark.createDataFrame(rows, "month string, a long, b long, n_stories long, pmi double")
    shapes, ranks = {r.month: r for r in N.monthly_shapes(edges).collect()}, N.monthly_pagerank(edges, rounds=20, top=3).collect()
    found = {r.month: r for r in N.monthly_communities(edges).collect()}
    for month in ("2024-01", "2024-02", "2024-03"):
        one_month = edges.where(F.col("month") == month)
        want = N.shape(one_month).first()
        assert shapes[month].components == want.components and shapes[month].largest_component_share == want.largest_component_share
        best = N.pagerank(one_month, rounds=20).withColumn("pr", F.round("pagerank", 9)).orderBy(F.desc("pr"), "node").limit(3).collect()
        assert [(r.node, round(r.pagerank, 9)) for r in sorted((r for r in ranks if r.month == month), key=lambda r: r.rank)] == [(r.node, r.pr) for r in best]
        parts = N.louvain(one_month)
        assert found[month].communities == parts.select("community").distinct().count()
        assert found[month].modularity == pytest.approx(N.modularity(one_month, parts).first()[0])


def test_shapes_take_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def month(m):
        made.add(1)
        return m

    edges = spark.createDataFrame([("m1", "x", "y"), ("m1", "u", "v"), ("m2", "x", "y")], "month string, a string, b string")
    got = N.monthly_shapes(edges.withColumn("month", month.asNondeterministic()("month"))).collect()
    assert sorted((r.month, r.components, r.largest_component_share) for r in got) == [("m1", 2, 0.5), ("m2", 1, 1.0)]
    assert made.value == 3


def test_tasks_of_stories_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.skew.TASK_ROWS", 50)
    rows = [("m", story, f"e{k}", f"t{story % 3}") for story in range(500) for k in {story % 2, 2 + story % 5}]
    se = spark.createDataFrame(rows, "month string, story_id long, entity_id string, topic string")
    edges = N.cooccurrence(se, 1, 1, -9.0, by=["month"])
    pairs = {}
    for story in range(500):
        a, b = sorted([f"e{story % 2}", f"e{2 + story % 5}"])
        pairs[a, b] = pairs.get((a, b), 0) + 1
    assert {(r.a, r.b): r.n_stories for r in edges.collect()} == pairs
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "20), REPARTITION_BY_NUM" in plan  # 1000 pairs in tasks of 50
    # a topic counts once for each story of an entity, also where rows are repeated
    doubled = se.unionByName(se)
    stories = {e: [t for _, _, x, t in rows if x == e] for e in {x for _, _, x, _ in rows}}
    want = {e: min(set(ts), key=lambda t: (-ts.count(t), t)) for e, ts in stories.items()}
    got = {r.entity_id: (r.topic, r.topic_share) for r in N.main_topic(doubled).collect()}
    assert got == {e: (t, stories[e].count(t) / len(stories[e])) for e, t in want.items()}


def test_offset_instants(spark):
    texts = {"2024-03-01T10:00:00+03:00": "2024-03-01 07:00:00", "2024-03-01T10:00:00Z": "2024-03-01 10:00:00", "2024-03-01T10:00:00": "2024-03-01 10:00:00", "2024-03-01T10:00:00.5-0130": None, "no": None}
    for text, want in texts.items():
        got = one(spark, S.offset_instant(F.col("t")).cast("string"), t=text)
        assert got == want or (want is None and (got is None or got.startswith("2024-03-01 11:30:00.5")))


def test_pmi(spark):
    se = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c")], "story_id long, entity_id string")
    assert {(r.a, r.b, r.pmi) for r in N.cooccurrence(se, 1, 1, -9.0).collect()} == {("a", "b", 0.0), ("a", "c", 0.0)}


def test_agreement(spark):
    same = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", 2)], "p string, q long")
    assert N.agreement(same, "p", "q").first()[1:] == pytest.approx((1.0, 1.0))


# --- resolution, model output, topics


GOOD = '{"summary": "s", "entities": [{"name": "A", "type": "ORG", "role": "actor", "sentiment": "pos", "normalized_id": "a"}], "topic": "спорт", "event_type": "прочее", "is_opinion": false, "confidence": 0.5}'
RAW = {
    1: GOOD,
    2: GOOD.replace('"confidence": 0.5', '"confidence": 1.5'),
    3: GOOD.replace('"topic": "спорт"', '"topic": "погода"'),
    4: GOOD.replace('"is_opinion": false', '"is_opinion": false, "extra": 1'),
    5: GOOD.replace('"role": "actor", ', ""),
    6: '{"summary": "cut',
    7: GOOD.replace('"type": "ORG"', '"type": "ANIMAL"'),
    8: GOOD.replace('"summary": "s"', f'"summary": "{"s" * 401}"'),
    9: '{"summary": "", "entities": [], "topic": "культура", "event_type": "заявление", "is_opinion": true, "confidence": 0}',
    10: GOOD.replace('"normalized_id": "a"', '"normalized_id": "a", "more": 2'),
}


def test_answers_are_validated(spark):
    rows = spark.createDataFrame([*RAW.items(), (11, None), (12, "")], "k long, raw string")
    assert {r.k for r in rows.select("k", E.is_valid(F.col("raw")).alias("ok")).where("ok").collect()} == {1, 9}


def test_flags(spark):
    figures = "0.9 AS valid_share, 0.5 AS topic_share, 0.6 AS event_share, 'neu' AS sentiment_top, 0.85 AS sentiment_share, 0.1 AS empty_share, 0.05 AS unseen_share, 0.02 AS truncated_share, 3 AS topics_used, 11 AS topics_known, 0.2 AS any_changed"
    assert {r.flag for r in E.flags(spark.sql(f"SELECT {figures}")).collect()} == {"invalid_json", "neutral_degenerate", "truncated", "few_topics"}


def test_names_seen(spark):
    names = {"Сбербанк": True, "Сбербанка России": True, "ВТБ": False, "": False, "Берег": True, "дом на": False}
    got = spark.createDataFrame([(k,) for k in names], "name string").select("name", X.seen_in_text(F.col("name"), F.lit("сбербанк и россия на берегу")).alias("seen"))
    assert {r.name: r.seen for r in got.collect()} == names


def test_geo_conflicts(spark):
    rows = [(0, "ORG", "мчс"), (1, "ORG", "гу мчс по москва"), (2, "ORG", "мчс россия"), (3, "LOC", "москва"), (4, "ORG", "комитет по чрезвычайный ситуация"), (5, "ORG", "гу мчс по свердловский область")]
    forms = spark.createDataFrame(rows, "form_id long, type string, alias_key string")
    every = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    edges = spark.createDataFrame([(a, b, ["emb"], 0.9) for a, b in every], "a long, b long, channels array<string>, score double")
    places = spark.createDataFrame([("москва",), ("москва",)], "alias_key string")
    mark = {0: "", 1: "москва", 2: "", 4: "", 5: "область свердловский"}
    got = {(r.a, r.b) for r in M.drop_geo_conflicts(edges, forms, places).collect()}
    assert got == {(a, b) for a, b in every if a == 3 or b == 3 or mark[a] == mark[b]}


def test_candidate_groups_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(a, b, ["emb"] if rng.random() < 0.8 else ["emb", "llm_vote"], round(rng.uniform(0.85, 1), 3)) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05]

    def parts(kept):
        label = {x: x for a, b, *_ in edges for x in (a, b)}
        for _ in label:
            for a, b, *_ in kept:
                label[a] = label[b] = min(label[a], label[b])
        return label

    kept, threshold = edges, 0.85
    while threshold < 0.99:
        label = parts(kept)
        size = {c: sum(x == c for x in label.values()) for c in label.values()}
        threshold = round(threshold + 0.02, 4)
        kept = [e for e in kept if size[label[e[0]]] <= 6 or "llm_vote" in e[2] or e[3] >= threshold]
    label, want = parts(kept), set()
    for c in set(label.values()):
        members = sorted(x for x in label if label[x] == c)
        blocks = [members[k : k + 6] for k in range(0, len(members), 6)]
        want |= {(x, block[0]) for block in blocks if len(block) > 1 for x in block}
    table = spark.createDataFrame(edges, "a long, b long, channels array<string>, score double")
    assert {(r.form_id, r.group) for r in R.candidate_groups(table, max_size=6).collect()} == want


def test_knn_leaves_out_unsound_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, None), (4, 0, [None, 1.0]), (5, 0, [float("nan"), 1.0]), (6, 0, []), (7, 0, [1.0]), (None, 0, [1.0, 0.0]), (8, None, [1.0, 0.0]), (9, 1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, kind int, v array<double>")
    assert [(r.a, r.b) for r in D.knn_pairs(table, threshold=0.5).collect()] == [(1, 2)]
    assert D.knn_pairs(table.limit(0)).count() == 0


def test_duplicates_of_odd_texts(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, same), (5, same), (6, "short text"), (7, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.exact_groups(docs).where("size > 1").collect()) == [4, 5]
    sets = D.shingle_sets(docs)
    assert D.near_pairs(sets).count() == D.lsh_pairs(sets).count() == 0
    assert D.exact_groups(docs.limit(0)).count() == D.near_pairs(D.shingle_sets(docs.limit(0))).count() == 0


def test_batches_next_fit(spark):
    rng = random.Random(8)
    sizes = [("a", g, rng.randrange(1, 60)) for g in range(50)] + [("b", 100, 250), ("b", 101, 1)]
    want, kind, batch, fill = [], None, 0, 0
    for t, g, n in sizes:
        if t != kind:
            kind, batch, fill = t, 0, 0
        if fill and fill + n > 100:
            batch, fill = batch + 1, 0
        want.append((t, batch, g, fill))
        fill += n
    got = R.make_batches(spark.createDataFrame(sizes, "type string, group long, n long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_groups_are_cut(spark):
    edges = spark.createDataFrame([(i, i + 1, ["emb"] if i % 2 else ["emb", "llm_vote"], 0.86) for i in range(30)], "a long, b long, channels array<string>, score double")
    got = R.candidate_groups(edges).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group, []).append(r.form_id)
    assert all(sorted(g) == [k, k + 1] for k, g in groups.items()) and len(groups) == 15
    votes = edges.withColumn("channels", F.array(F.lit("llm_vote")))
    sizes = [r["count"] for r in R.candidate_groups(votes).groupBy("group").count().orderBy("group").collect()]
    assert sizes == [20, 11]


def test_merge_pairs(spark):
    accepted = spark.createDataFrame([("b", 1, 1), ("b", 2, 1), ("b", 5, 1), ("b", 9, 9)], "batch_id string, form_id long, part long")
    assert sorted(tuple(r) for r in R.merge_pairs(accepted).collect()) == [(1, 2), (1, 5), (2, 5)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.95,), (1.0,)], "confidence double")
    assert [r["count"] for r in E.confidence_histogram(df).orderBy("bin").collect()] == [2, 0, 1, 0, 0, 0, 0, 0, 0, 2]


def test_coherence(spark):
    texts = ["red blue green"] * 20 + ["cat dog cow"] * 20 + ["red cat", "blue dog"]
    docs = spark.createDataFrame([(t.split(),) for t in texts], "words array<string>")
    top = spark.createDataFrame([("good", 1, "red"), ("good", 2, "blue"), ("good", 3, "green"), ("mixed", 1, "red"), ("mixed", 2, "dog"), ("mixed", 3, "cow")], "topic string, rank int, word string")
    got = {r.topic: r.coherence for r in P.coherence(top, docs).collect()}
    assert got["good"] > got["mixed"] and got["good"] > 0.9


def test_tokens_are_read_once(spark):
    tokens = spark.createDataFrame([("x", "a b a"), ("y", "b c")], "topic string, text string").select("topic", F.explode(F.split("text", " ")).alias("word"))
    weights = P.term_weights(tokens)
    assert "Generate" not in weights._jdf.queryExecution().toString()  # counts are settled, not made again for each total
    assert {(r.topic, r.word): r.n for r in weights.collect()} == {("x", "a"): 2, ("x", "b"): 1, ("y", "b"): 1, ("y", "c"): 1}


def test_knn_ties_against_brute_force(spark):
    rng = random.Random(4)
    v = {i: [float(rng.randrange(3)), float(rng.randrange(3))] for i in range(60)}
    got = {(r.a, r.b, r.score) for r in D.knn_pairs(spark.createDataFrame([(i, "k", x) for i, x in v.items()], "id long, kind string, v array<double>"), k=4, threshold=2.0).collect()}
    score = lambda i, j: v[i][0] * v[j][0] + v[i][1] * v[j][1]
    near = {i: sorted((j for j in v if j != i and score(i, j) >= 2.0), key=lambda j: (-score(i, j), j))[:4] for i in v}
    assert got == {(min(i, j), max(i, j), score(i, j)) for i in v for j in near[i]}


def test_topic_merging(spark):
    rows = [("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 0.9), ("c", "z", 1.0)]
    assert P.merge_topics(spark.createDataFrame(rows, "topic string, word string, weight double"), 2) == {"a": "a", "b": "a", "c": "c"}


def test_defaults_are_those_of_the_parameter_object(spark):
    import inspect

    from millrace import params as A

    whole = A.Params()
    used = {
        whole.stories: (D.shingle_sets, D.band_pairs, T.split_stories),
        whole.entities: (D.knn_pairs, R.candidate_groups, R.make_batches, M.vote_pairs, M.gazetteer),
        whole.series: (S.dense_series, S.zscore, B.burst_states, B.bursts, B.match_events),
        whole.network: (N.pagerank, N.strong_edges, N.monthly_pagerank),
    }
    for stage, operators in used.items():
        met = set()
        for operator in operators:
            known, own = inspect.signature(operator).parameters, A.of(stage, operator)
            met |= set(own)
            assert own and all(known[k].default == v for k, v in own.items())
        assert met == {f for f in vars(stage)} or stage is whole.network
    assert set(A.of(whole.network, N.cooccurrence)) == {"min_stories", "min_pair", "min_pmi"}
    with pytest.raises(Exception):
        whole.series.window = 3
    assert A.of(A.Series(window=14), S.zscore) == {"window": 14, "threshold": 3.0, "min_stories": 5}


def test_near_copies_meet_once_for_a_run_of_common_keys(spark, monkeypatch):
    """Of k texts that differ in one word a pair shares some fifty keys; it is sent for the first of each run of them, and none is lost."""
    rows = []
    for i in range(30):
        words = [f"w{k}" for k in range(300)]
        words[7 * i + 20] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    asked, verified = [], D._verified
    monkeypatch.setattr(D, "_verified", lambda candidates, *more: asked.append(candidates) or verified(candidates, *more))
    assert {(r.a, r.b) for r in D.near_pairs(sets).collect()} == set(itertools.combinations(range(30), 2))
    asked[0].collect()
    assert 30 * 29 // 2 <= max(_rows_of_joins(asked[0])) < 30 * 29 // 2 * 15


def _rows_of_joins(df):
    """Output rows of the joins of a plan that has run."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("cell", [512, 8])
def test_forest_of_near_pairs_has_their_components(spark, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL_SETS", cell)
    rng, rows = random.Random(11), []
    for i in range(120):
        words = [f"{i % 3}_{k}" for k in range(200)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    every, some = D.near_pairs(sets), D.near_pairs(sets, forest=True)
    parts = [{r.node: r.component for r in connected_components(p, "a", "b").collect()} for p in (every, some)]
    assert parts[0] == parts[1] and len(parts[0]) > 60
    scores = {(r.a, r.b): r.score for r in every.collect()}
    few = {(r.a, r.b): r.score for r in some.collect()}
    assert few.items() <= scores.items()
    assert len(few) < len(scores) / 2 if cell == 8 else len(few) == len(parts[0]) - len(set(parts[0].values()))


def test_texts_are_read_once_for_digests_and_shingles(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    groups, sets = D.groups_and_sets(docs)
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, D.exact_groups(docs).collect()))
    firsts = {r.doc_id for r in groups.where("doc_id = first").collect()}
    ids = [r.doc_id for r in sets.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= firsts
    assert "documents.parquet" not in sets._jdf.queryExecution().toString() and "regexp_replace" not in sets._jdf.queryExecution().toString()


def test_rounds_without_an_edge_to_cut_find_no_components(spark, monkeypatch):
    found, real = [], T.connected_components
    monkeypatch.setattr(T, "connected_components", lambda *args: found.append(args) or real(*args))
    held = spark.createDataFrame([(i, i + 1, "minhash", 0.905) for i in range(70)], "a long, b long, level string, score double")
    assert {r.component for r in T.split_stories(held).collect()} == {0} and len(found) == 1
    mixed = held.unionByName(spark.createDataFrame([(70, 71, "semantic", 0.955)], held.schema))
    assert {r.node: r.component for r in T.split_stories(mixed).collect()} == {**{i: 0 for i in range(71)}, 71: 71} and len(found) == 3


def test_sets_that_share_one_key_by_chance_are_no_candidates(spark, monkeypatch):
    """Any two of these sets share one shingle: their number is a square, and none can be similar."""
    rng = random.Random(21)
    shared = {pair: rng.getrandbits(63) for pair in itertools.combinations(range(30), 2)}
    rows = [(i, sorted(h for pair, h in shared.items() if i in pair), 29) for i in range(30)]
    asked, verified = [], D._verified
    monkeypatch.setattr(D, "_verified", lambda candidates, *more: asked.append(candidates) or verified(candidates, *more))
    assert D.near_pairs(spark.createDataFrame(rows, "doc_id long, sh array<long>, n int")).count() == asked[0].count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_pairs_of_small_sets_lose_none(spark, threshold):
    """Sets of one shingle and more, of which similar ones have one, two or more in common."""
    rng = random.Random(22)
    hashes, sets = [rng.getrandbits(64) - 2**63 for _ in range(12)], set()
    while len(sets) < 150:
        sets.add(tuple(sorted(rng.sample(hashes, rng.choice([1, 2, 3, 4, 5, 6, 8, 10])))))
    rows = list(enumerate([*sorted(sets), (hashes[0],), tuple(sorted(hashes[:2]))]))
    got = {(r.a, r.b): r.score for r in D.near_pairs(spark.createDataFrame([(i, list(s), len(s)) for i, s in rows], "doc_id long, sh array<long>, n int"), threshold).collect()}
    want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for (i, x), (j, y) in itertools.combinations(rows, 2)}
    assert got == {pair: score for pair, score in want.items() if score >= threshold}


def test_near_pairs_that_may_be_cut_hold_no_forest_together(spark):
    """Stories over a forest of near pairs and semantic ones are those over all near pairs, also where a near pair is semantic."""
    rng, rows = random.Random(23), []
    for i in range(40):
        words = [f"{i % 4}_{k}" for k in range(150)]
        words[3 * i] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = D.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    every = D.near_pairs(sets)
    near = [(r.a, r.b) for r in every.collect()]
    cut = [p for p in near if p[0] in (0, 1)] + rng.sample(near, 20)  # 0 and 1 hang on semantic edges alone
    semantic = spark.createDataFrame([(a, b, "semantic", 0.3) for a, b in {*cut, (2, 3)}], "a long, b long, level string, score double")
    some = D.near_pairs(sets, forest=True, apart=semantic)
    level = lambda p: p.select("a", "b", F.lit("minhash").alias("level"), "score").unionByName(semantic)
    want, got = ({r.node: r.component for r in T.split_stories(level(p), 5, 0.3, 0.1, 0.5).collect()} for p in (every, some))
    assert got == want and want[4] != 0 and want[0] == 0 and want[1] == 1
    assert some.count() < len(near) / 2 and not {(r.a, r.b) for r in some.collect()} & set(cut)
