"""Sentences, claims, page extraction, near duplicates, matching and scoring on fixed texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scalars as K
from seriesloom.functions import wordlists as L
from seriesloom.operators import evidence as E
from seriesloom.operators import text as T
from seriesloom.plans import catalog
from seriesloom.sources import readers as R

ABSTRACTS = {
    1: "Sea level rose at 3.4 ± 0.1 mm/yr since 1993. No further detail is given.",
    2: "Ice extent declined by 13% per decade. The loss was not uniform.",
    3: "Emissions showed no significant change.",
    4: "The link was strong (r = 0.89). Other work, e.g. by Lee et al. in 2001, agrees.",
    5: "Prices were discussed in a vague way.",
    6: "",
}


@pytest.fixture(scope="module")
def claims(spark):
    df = spark.createDataFrame(list(ABSTRACTS.items()), "id int, text string")
    return {(r.id, r.pos): r for r in T.extract_claims(df, "id", "text").collect()}


def test_value_unit_claim(claims):
    c = claims[(1, 0)]
    assert (c.value, c.unit, c.direction) == (3.4, "mm/yr", "increase") and c.confidence == pytest.approx(0.7)


def test_percent_claim_before_decade(claims):
    c = claims[(2, 0)]
    assert (c.value, c.unit, c.direction) == (13.0, "% per decade", "decrease")
    assert claims[(2, 1)].value is None and claims[(2, 1)].direction == "decrease" and claims[(2, 1)].confidence == pytest.approx(0.2)


def test_no_change_wins_and_statistics(claims):
    assert claims[(3, 0)].direction == "no change"
    assert (claims[(4, 0)].value, claims[(4, 0)].unit) == (0.89, "r-value")
    assert not [k for k in claims if k[0] in (5, 6)]


def test_abbreviations_do_not_split(spark):
    s = spark.createDataFrame([("It rose, e.g. In May. Next one is 3.5 long. End",)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert s == ["It rose, eg. In May.", "Next one is 3.5 long.", "End"]


PAGE = """<html><head><title>T &amp; U</title><meta name="author" content="Ann Lee"><meta property="article:published_time" content="2024-03-01">
<script>var x = "<p>no</p>";</script></head><body><nav>menu</nav><article><h1>Head</h1><p>First   part &#8364;5.</p><!-- gone --><p>Accept all cookies now</p><p>%s</p></article><footer>foot</footer></body></html>"""


def test_html_extract(spark):
    df = spark.createDataFrame([("https://www.Example.org/a?b", PAGE % " ".join(["word"] * 60))], "url string, html string")
    r = T.html_extract(df).first()
    assert (r.domain, r.title, r.author, r.date, r.ok) == ("example.org", "T & U", "Ann Lee", "2024-03-01", True)
    assert r.text.startswith("Head\n\nFirst   part €5.") and "cookies" not in r.text and "menu" not in r.text and "gone" not in r.text


NESTED = """<html><head><meta name='author' content='Ann'><meta content=2024-05-06 name=date><META PROPERTY="og:title" CONTENT="a > b"></head>
<body><nav>x<nav>y</nav>z</nav><article>one <ARTICLE class='q'>inner</ARTICLE> two three</article><article>later</article><aside>open</body></html>"""


def test_nested_elements_and_quoting(spark):
    """Elements of one name inside each other, attributes in all quotings, an element that is never closed."""
    df = spark.createDataFrame([("http://a.b/", NESTED), ("http://a.b/", None), ("http://a.b/", ""), ("http://a.b/", "<article>x<article>y")],
                               "url string, html string")
    rows = T.html_extract(df).collect()
    assert rows[0].text.split() == ["one", "inner", "two", "three"]
    assert (rows[0].author, rows[0].date, rows[0].title) == ("Ann", "2024-05-06", "a > b")
    assert rows[3].text.split() == ["x", "y"]
    cut = df.limit(1).select(T.drop_element(F.lit("a<nav>b<nav>c</nav>d</nav>e<nav>f</nav >g<nav>h"), "nav").alias("v")).first().v
    assert cut == "aeg<nav>h"


def test_key_paragraph_order(spark):
    good = "In 2021 the output grew 45% to 3.2 billion units while the cost fell by 12 and the share rose to 30 of 100 in all regions."
    plain = "This paragraph has more than ten words but it does not carry any fact."
    df = spark.createDataFrame([(f"{plain}\n\nshort one\n\n{good}",)], "t string")
    got = df.select(T.key_paragraphs(F.col("t")).alias("p")).first().p
    assert [p.text for p in got] == [good, plain]


def test_web_claims_filter(spark):
    keep = "The total output of the plant has increased by 45 percent to 3.2 billion units in 2021 across all regions."
    drop = "Retrieved 12 May 2020 from the archive of the office, which has 45 percent of all files in 2021."
    part = "The total output of the plant has increased by 45 percent."
    df = spark.createDataFrame([(1, f"{keep} {drop} Is this a question that has 45 percent of all the answers in 2021? {part}")], "id int, t string")
    got = [r.claim for r in T.web_claims(df, "id", "t").collect()]
    assert keep in got and not any("Retrieved" in c or "question" in c for c in got)


def terms_of(text):
    from seriesloom.functions.wordlists import CLAIM_STOP_WORDS
    return {w for w in re.findall(r"\b[a-z]{3,}\b", text.lower()) if w not in CLAIM_STOP_WORDS}


@pytest.fixture(scope="module")
def near_texts():
    rng = np.random.default_rng(9)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    base = [" ".join(rng.choice(vocab, 14, replace=False)) for _ in range(30)]
    rows = []
    for i in range(150):
        words = base[rng.integers(0, 30)].split()
        for j in rng.integers(0, 14, rng.integers(0, 6)):
            words[j] = str(rng.choice(vocab))
        rows.append((i, "q" if i % 3 else "r", " ".join(words)))
    return rows


def test_dedup_near_is_sequential(spark, near_texts):
    df = spark.createDataFrame(near_texts, "id int, g string, t string")
    got = {r.id for r in E.dedup_near(df, ["g"], "id", "t").collect()}
    want = set()
    for g in "qr":
        kept = []
        for i, gg, t in near_texts:
            s = terms_of(t)
            if gg == g and s and not any(len(s & k) / len(s | k) > 0.6 for k in kept):
                kept.append(s)
                want.add(i)
    assert got == want


def test_jaccard_pairs_match_brute_force(spark, near_texts):
    df = spark.createDataFrame(near_texts, "id int, g string, t string").withColumn("s", T.claim_terms(F.col("t")))
    for above in (0.3, 0.6, 0.8):
        got = {(r.a, r.b) for r in E.jaccard_pairs(df, ["g"], "id", "s", above).collect()}
        want = {(a[0], b[0]) for i, a in enumerate(near_texts) for b in near_texts[i + 1:]
                if a[1] == b[1] and len(terms_of(a[2]) & terms_of(b[2])) / len(terms_of(a[2]) | terms_of(b[2])) > above}
        assert got == want


def test_jaccard_pairs_of_many_blocks_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        s = set(rng.sample(words, rng.choice([3, 8, 20, 60, 150, 300])))
        rows.append((i * 2, "g", sorted(s)))
        rows.append((i * 2 + 1, "g", sorted(set(list(s)[: max(1, len(s) * rng.randint(6, 10) // 10)]))))
    df = spark.createDataFrame(rows, "id int, g string, s array<string>")
    for size in (5, 1 << 15):
        monkeypatch.setattr(E, "BLOCK_SETS", size, raising=False)
        for above in (0.3, 0.6, 0.9):
            got = sorted((r.a, r.b, round(r.jaccard, 9)) for r in E.jaccard_pairs(df, ["g"], "id", "s", above).collect())
            js = [(a[0], b[0], len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2]))) for i, a in enumerate(rows) for b in rows[i + 1:]]
            assert got == sorted((a, b, round(j, 9)) for a, b, j in js if j > above)


def test_jaccard_pairs_shuffle_no_pairs_of_unlike_sets(spark):
    """Sets of terms in common use: nearly all share some of their rarest terms, none is similar to another."""
    rng = random.Random(3)
    rows = [(i, "g", sorted(rng.sample([f"w{k}" for k in range(200)], 60))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, s array<string>")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        gateway = spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert E.jaccard_pairs(df, ["g"], "id", "s", 0.6).count() == 0
    assert written() - before < 10_000


def test_consistency_matches_brute_force(spark):
    sets = {1: "abc", 2: "abd", 3: "abc", 4: "xyz", 5: "a"}
    df = spark.createDataFrame([("g", k, t) for k, ts in sets.items() for t in ts], "g string, src int, term string")
    for r in E.consistency(df, "g", "src").collect():
        js = [len(set(sets[r.src]) & set(o)) / len(set(sets[r.src]) | set(o)) for k, o in sets.items() if k != r.src]
        assert r.mean_overlap == pytest.approx(sum(js) / 4) and r.max_overlap == pytest.approx(max(js))


def test_finding_and_match(spark):
    found = spark.range(1).select(*[c.alias(n) for n, c in E.parse_finding(F.lit("Sea level rose 3.4 mm/yr from 1993 to 2024")).items()]).first()
    assert (found.value, found.unit, found.direction) == (3.4, "mm/yr", "increase") and "sea" in found.keywords and "rose" not in found.keywords
    claims = spark.createDataFrame([(1, "Sea level rose at 3.3 mm/yr.", 3.3, "increase"), (2, "Sea level fell.", None, "decrease"), (3, "Prices grew.", 30.0, "increase"), (4, "Nothing.", None, None)],
                                   "id int, claim string, value double, direction string")
    got = E.match_findings(claims, ["Sea level rose 3.4 mm/yr from 1993 to 2024"], ["id"], 3).orderBy("rank").collect()
    assert (got[0].id, got[0].agreement) == (1, "agrees") and {r.id: r.agreement for r in got}[2] == "disagrees"


def test_theme_growth(spark):
    pairs = spark.createDataFrame([("q", "a", "b", 9), ("q", "b", "c", 8), ("q", "x", "y", 5), ("q", "c", "x", 2)], "g string, t1 string, t2 string, n long")
    dist = spark.createDataFrame([("q", t, n) for t, n in (("a", 9), ("b", 9), ("lone", 7))], "g string, term string, df long")
    got = E.grow_themes(pairs, dist, "g").groupBy("theme").agg(F.array_sort(F.collect_list("term")).alias("ts")).orderBy("theme").collect()
    assert [r.ts for r in got] == [["a", "b", "c", "x"], ["lone"]] or got[0].ts[:3] == ["a", "b", "c"]


def test_reputation_ladder(spark):
    known = spark.createDataFrame([("a.example", 9), ("parent.example", 7)], "domain string, score int")
    df = spark.createDataFrame([("a.example",), ("x.parent.example",), ("u.edu",), ("z.org",), ("q.io",)], "domain string")
    assert {r.domain: r.reputation for r in E.reputation(df, known).collect()} == {"a.example": 9.0, "x.parent.example": 7.0, "u.edu": 8.0, "z.org": 5.0, "q.io": 4.0}


def test_freshness(spark):
    df = spark.createDataFrame([("2024-05-30", ""), ("May 1, 2024", ""), ("", "seen in 2024"), ("", "nothing"), ("2030-01-01", "")], "d string, t string")
    got = [r.f for r in df.select(E.freshness(F.col("d"), F.col("t"), F.lit("2024-06-01").cast("date")).alias("f")).collect()]
    assert got == [10.0, 8.0, 7.0, 5.0, 5.0]


def test_abstract_round_trip(spark):
    df = spark.createDataFrame([(1, "to be or not to be")], "id int, t string")
    out = R.inverted_index(df, "id", "t").select(R.rebuild_abstract(F.col("inverted")).alias("a")).first().a
    assert out == "to be or not to be"


def test_citation_labels(spark):
    df = spark.createDataFrame([([], 2001, "A title"), (["Ann Lee"], None, ""), (["Ann Lee", "Bo Ray"], 1999, ""), (["A B", "C D", "E F"], 5, "")], "a array<string>, y int, t string")
    got = [r.c for r in df.select(T.citation_label(F.col("a"), F.col("y"), F.col("t")).alias("c")).collect()]
    assert got == ['"A title", 2001', "Lee, n.d.", "Lee & Ray, 1999", "B et al., 5"]


def test_slug_and_dates(spark):
    r = spark.range(1).select(K.slug(F.lit("What is the State of Solar Power in 2024?")).alias("s"), K.parse_any_date(F.lit("3 March 2021")).alias("d"),
                              K.parse_any_date(F.lit("no date")).alias("n")).first()
    assert r.s == "state-solar-power-2024" and str(r.d) == "2021-03-03 00:00:00" and r.n is None


def test_catalog_csv_typing(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,r,m\na,1.5,2\nb,,null\nc,x,3\n")
    got = {r.name: (r.r, r.m) for r in R.read_catalog_csv(spark, str(tmp_path / "c.csv"), {"name": "string", "r": "double", "m": "int"}).collect()}
    assert got == {"a": (1.5, 2), "b": (None, None), "c": (None, 3)}


def test_columnar_and_record_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"daily": {"time": ["2020-01-01", "2020-01-02"],\n "v": [1.0, null]}}')
    rows = R.read_columnar_json(spark, str(tmp_path / "d.json"), "daily", {"time": "string", "v": "double"}).collect()
    assert [(r.time, r.v) for r in rows] == [("2020-01-01", 1.0), ("2020-01-02", None)]
    (tmp_path / "r.json").write_text('{"site_id": "s1",\n "records": [{"date": "2020-01-01", "flow": 3.5}, {"date": "2020-01-02", "flow": null}]}')
    recs = R.read_records_json(spark, str(tmp_path / "r.json"), {"site_id": "string"}, "records", {"date": "date", "flow": "double"}).collect()
    assert [(r.site_id, r.flow) for r in recs] == [("s1", 3.5), ("s1", None)]


def test_write_result_has_finite_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "id int, v double")
    R.write_result(df, str(tmp_path / "o"))
    assert {r.id: r.v for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {1: None, 2: None, 3: 1.0}


def test_source_score_sql_states_the_rule(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from seriesloom.plans import catalog
    catalog.load_all()
    heads = ["", '<meta name="author" content="Ann Lee">', "<meta property='article:published_time' content='2026-05-20T10:00:00Z'>", '<meta name="date" content="May 3, 2025">',
             '<meta name="DATE" content="12 Mar 2019"><meta content="X" name="author">', '<meta name="date" content="on 2027-01-05 or so">', '<meta name="date" content="someday">',
             '<meta name="pubdate" content="2026/1/5">', '<meta name="date" content="2026-05-30T23:30:00+0200">']
    words = ["", " of 2023", " of 2024 and 2025", " of 2026", " of 2031", " of 1999"]
    page = "<html><head><title>T</title>{}</head><body><p>{}</p>{}</body></html>"
    rows = [(i * 10 + j, "http://www.example.org/a", page.format(h, "some words here " * 20 + w, "<time datetime='2024-02-02'>x</time>" if j == 5 else ""))
            for i, h in enumerate(heads) for j, w in enumerate(words)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["l06_source_score"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(catalog.SQL["l06_source_score"])
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())
    assert got.select("freshness").distinct().count() >= 7


def test_claim_patterns_run_once(spark):
    df = spark.createDataFrame(list(ABSTRACTS.items()), "id int, text string")
    claims = T.extract_claims(df, "id", "text")
    plan = claims._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("negative trend") == 1
    best = E.match_findings(claims, ["Sea level rose 3.4 mm/yr", "Ice declined"], ["id", "pos"], 3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("negative trend") == 1 and plan.count("[a-zA-Z]+") == 1


def test_inverted_index_stays_in_its_row(spark):
    df = spark.createDataFrame([(1, " b a\nb  c b "), (2, ""), (3, None), (4, "x")], "id int, text string")
    out = R.inverted_index(df, "id", "text")
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.inverted for r in out.collect()} == {1: {"a": [1], "b": [0, 2, 4], "c": [3]}, 4: {"x": [0]}}


def test_theme_claims_are_made_once_and_not_broadcast(spark):
    """Claims come from one written table, whose estimate is its size; only the distinctive terms may be sent to every task."""
    catalog.load_all()
    plan = catalog.QUERIES["l11_themes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    built = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "part.parquet" not in plan and "p_name" not in plan
    assert not any("cid" in line or "p_partkey" in line for line in built)


def test_works_without_words_and_with_vertical_tabs_match_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a\x0bb c", "\x0b", " \t\n", "", None, " b a\r\nb\x0c ", "a\u00a0b\u0085c \u3000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    catalog.load_all()
    got = catalog.QUERIES["a06_normalise_works"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(catalog.SQL["a06_normalise_works"]).fetchall())


def test_clean_up_marks_are_found_wherever_a_pattern_is():
    texts = ["- a b", "•\tx", "a[12, 3]b", "a[x]", "^ note", "seaLevel rise", "iPhone", "Open Menu", "Openly", "ab– cd2024-01-02 Commented on", "12@ab c", "a 1@b", "",
             *ABSTRACTS.values()]
    for (pattern, _), mark in zip(L.CLAIM_CLEANUP, L.CLAIM_CLEANUP_MARKS, strict=True):
        found = [t for t in texts if re.search(pattern, t)]
        assert found and all(re.search(mark, t) for t in found) and any(not re.search(mark, t) for t in texts)


def test_page_texts_are_worked_out_once(spark):
    """Each pattern of the page's title and main text stands once in the plan, however often its result is named."""
    pages = spark.createDataFrame([("https://a.org/x", "<title>A &#65;&lt;</title><body>Text &#66; here<p>ADVERTISEMENT</p><p>More &amp; text</p></body>"), ("u", None), ("u", "")], "url string, html string")
    out = T.html_extract(pages)
    plan = out.select("title", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title") == 1 and plan.count("</article") == 1
    assert [tuple(r) for r in out.select("domain", "title", "text").collect()] == [("a.org", "A A<", "Text B here\n\nMore & text"), ("", "", None), ("", "", "")]


def test_relevance_counts_words_only(spark):
    df = spark.createDataFrame([(["ring", "co2", "sea"], "Ring of co2, ring", "the SEA", "x.org")], "terms array<string>, title string, text string, domain string")
    got = df.select(E.relevance(F.col("terms"), F.lit(9), F.col("title"), F.col("text"), F.col("domain")).alias("r")).first().r
    assert abs(got - (0.5 + 3 / 3 + 2.5 / 3 + 0.5)) < 1e-9
