"""Text and evidence queries."""

from pyspark.sql import functions as F

from seriesloom.functions import wordlists as L
from seriesloom.operators import evidence as E
from seriesloom.operators import text as T
from seriesloom.plans import sqltext as Q
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.session import stored
from seriesloom.sources.readers import read_table

TODAY = "2026-06-01"

# ---- derived inputs ------------------------------------------------------------------------------------------

VERBS = ["increased", "declined", "remained stable", "rose", "moved", "fell", "grew"]
UNITS = ["mm/yr", "% per year", "°C per decade", "km", "percent"]


def abstracts(t):
    """One short abstract per part, written from its columns."""
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("p_size") % 7 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    num = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    text = F.concat(F.lit("The price of "), F.col("p_name"), F.lit(" "), verb, F.lit(" at "), num, F.lit(" "), unit, F.lit(" in "), F.lower("p_type"),
                    F.lit(" markets. Sales of "), F.lower("p_brand"), F.lit(" were higher, e.g. in towns with r = 0."), (F.col("p_size") % 9 + 1).cast("string"),
                    F.lit(" overall. Stock was "), (F.col("p_partkey") % 100).cast("string"), F.lit("% of the plan. Demand fell."))
    return read_table(t.spark, f"{t.folder}/part.parquet", cpu_heavy=True).select("p_partkey", "p_name", "p_brand", text.alias("text"))


ABSTRACTS = f"""abstracts AS (SELECT p_partkey, p_name, concat('The price of ', p_name, ' ', list_extract({Q.words_list(VERBS)}, p_size % 7 + 1), ' at ', p_size, '.', p_partkey % 10, ' ',
  list_extract({Q.words_list(UNITS)}, CAST(p_partkey % 5 + 1 AS BIGINT)), ' in ', lower(p_type), ' markets. Sales of ', lower(p_brand), ' were higher, e.g. in towns with r = 0.', p_size % 9 + 1,
  ' overall. Stock was ', p_partkey % 100, '% of the plan. Demand fell.') AS text FROM part)"""
ABSTRACT_CLAIMS = f"""{ABSTRACTS}, ss AS (SELECT p_partkey, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (SELECT p_partkey, {Q.sentences('text')} AS l FROM abstracts)),
cl AS ({Q.claims('ss', 'p_partkey')})"""

# ---- pages ---------------------------------------------------------------------------------------------------

BODY = Q.drop_elements("html")
PAGE_SQL = f"""px AS (SELECT page_id, url, html, {BODY} AS b FROM pages),
pg AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') AS domain,
  coalesce(nullif({Q.strip(Q.plain_text(Q.element('html', 'title'), "' '"))}, ''), {Q.strip(Q.plain_text(Q.element('html', 'h1'), "' '"))}) AS title,
  {Q.clean_text(Q.plain_text(f"coalesce(nullif({Q.element('b', 'article')}, ''), nullif({Q.element('b', 'main')}, ''), nullif({Q.element('b', 'body')}, ''), b)", "chr(10) || chr(10)"))} AS text FROM px)"""


def page_table(t):
    return T.html_extract(t.pages)


@query("l01_html_extract", f"""
WITH {PAGE_SQL} SELECT page_id, domain, title, md5(text) AS text_md5, CAST({Q.count('text', r'\S+')} AS BIGINT) AS word_count, {Q.count('text', r'\S+')} >= 50 AS ok FROM pg""")
def _(t):
    return page_table(t).select("page_id", "domain", "title", F.md5("text").alias("text_md5"), F.col("word_count").cast("bigint").alias("word_count"), "ok")


@query("l02_clean_text", f"SELECT doc_id, md5({Q.clean_text('text')}) AS text_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("text_md5"))


@query("l03_key_paragraphs", f"""
WITH kp AS ({Q.key_paragraphs('documents', 'doc_id', 'text')}) SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos, CAST(score AS BIGINT) AS score, md5(p) AS paragraph FROM kp""")
def _(t):
    d = t.documents.select("doc_id", F.posexplode(T.key_paragraphs(F.col("text"))).alias("r", "p"))
    return d.select("doc_id", (F.col("r") + 1).cast("bigint").alias("rank"), F.col("p.pos").cast("bigint").alias("pos"), (-F.col("p.neg")).cast("bigint").alias("score"), F.md5("p.text").alias("paragraph"))


@query("l04_split_sentences", f"""
SELECT doc_id, len(s) AS n_sentences, max(length(x)) AS longest, md5(string_agg(x, '|' ORDER BY i)) AS sentences FROM (
  SELECT doc_id, s, unnest(s) AS x, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)) GROUP BY doc_id, s""")
def _(t):
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.array_max(F.transform(s, lambda x: F.length(x))).cast("bigint").alias("longest"), F.md5(F.array_join(s, "|")).alias("sentences")).filter("n_sentences > 0")


TERMS = f"""w AS (SELECT doc_id, unnest({Q.words_of('text')}) AS term FROM documents), tc AS (SELECT doc_id, term, count(*) AS n FROM w WHERE NOT list_contains({Q.words_list(L.TERM_STOP_WORDS)}, term) GROUP BY 1, 2),
kt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM tc QUALIFY rank <= 30)"""


@query("l05_key_terms", f"WITH {TERMS} SELECT doc_id, term, n, CAST(rank AS INTEGER) AS rank FROM kt")
def _(t):
    return T.key_terms(t.documents, "doc_id", "text")


KNOWN = [("ththre.example.com", 8), ("example.net", 6), ("m.ththth.example.net", 3), ("example.org", 7)]
KNOWN_SQL = "known(kd, ks) AS (VALUES ('ththre.example.com', 8.0), ('example.net', 6.0), ('m.ththth.example.net', 3.0), ('example.org', 7.0))"

# Author, date, its age in days and the latest recent year that the text names.
ABOUT_SQL = f"""mt AS (SELECT page_id, html, list_transform(regexp_extract_all(html, {Q.q(Q.META_TAG)}), lambda m: {{'name': lower({Q.attribute('m', 'name')}), 'property': lower({Q.attribute('m', 'property')}), 'content': {Q.attribute('m', 'content')}}}) AS ms FROM pages),
wr AS (SELECT page_id, {Q.first_filled(Q.meta_content('ms', n) for n in L.AUTHOR_NAMES)} AS author, {Q.first_filled([*(Q.meta_content('ms', n) for n in L.DATE_NAMES),
  Q.attribute(f"regexp_extract(html, {Q.q(Q.TIME_TAG)})", 'datetime'), Q.plain_text(Q.element('html', 'time'), "' '")])} AS date FROM mt),
ad AS (SELECT page_id, author, date, CAST(floor((epoch(TIMESTAMP '{TODAY}') - {Q.any_date_epoch('date')}) / 86400) AS BIGINT) AS age,
  list_max(list_transform(regexp_extract_all(text, '\\b(202[3-9]|203\\d)\\b'), lambda y: CAST(y AS INTEGER))) AS last_year FROM wr JOIN pg USING (page_id))"""

WC, KPN = Q.count("text", r"\S+"), "coalesce(n_key, 0)"
SCORED = f"""{PAGE_SQL}, {ABOUT_SQL}, {KNOWN_SQL}, kp AS ({Q.key_paragraphs('pg', 'page_id', 'text')}), kn AS (SELECT page_id, count(*) AS n_key FROM kp GROUP BY 1),
sc AS (SELECT pg.page_id, domain, coalesce(a.ks, CASE WHEN len(string_split(domain, '.')) > 2 THEN b.ks END, CASE WHEN domain LIKE '%.edu' OR domain LIKE '%.gov' OR domain LIKE '%.ac.uk' OR domain LIKE '%.ac.jp' OR domain LIKE '%.edu.au' OR domain LIKE '%.gov.uk' THEN 8
   WHEN domain LIKE '%.mil' OR domain LIKE '%.int' THEN 7 WHEN domain LIKE '%.org' THEN 5 ELSE 4 END)::DOUBLE AS reputation,
  CASE WHEN {WC} = 0 THEN 0 ELSE least(10, CASE WHEN {WC} >= 2000 THEN 3 WHEN {WC} >= 800 THEN 2 WHEN {WC} >= 300 THEN 1.5 WHEN {WC} >= 100 THEN 0.5 ELSE 0 END
   + CASE WHEN {Q.count('text', r'\b\d[\d,.]*\b')} * 100.0 / {WC} > 3 THEN 2.5 WHEN {Q.count('text', r'\b\d[\d,.]*\b')} * 100.0 / {WC} > 1.5 THEN 1.5 WHEN {Q.count('text', r'\b\d[\d,.]*\b')} * 100.0 / {WC} > 0.5 THEN 0.5 ELSE 0 END
   + CASE WHEN {Q.count('text', L.QUANTITY_MARKS)} >= 10 THEN 1.5 WHEN {Q.count('text', L.QUANTITY_MARKS)} >= 3 THEN 1 WHEN {Q.count('text', L.QUANTITY_MARKS)} >= 1 THEN 0.5 ELSE 0 END
   + CASE WHEN {KPN} >= 8 THEN 1.5 WHEN {KPN} >= 4 THEN 1 WHEN {KPN} >= 1 THEN 0.5 ELSE 0 END + CASE WHEN title <> '' THEN 0.5 ELSE 0 END + CASE WHEN author <> '' THEN 0.5 ELSE 0 END) END::DOUBLE AS substance,
  CASE WHEN age IS NOT NULL THEN CASE WHEN age < 0 THEN 5 WHEN age <= 7 THEN 10 WHEN age <= 30 THEN 9 WHEN age <= 90 THEN 8 WHEN age <= 180 THEN 7 WHEN age <= 365 THEN 6 WHEN age <= 730 THEN 4.5 WHEN age <= 1825 THEN 3 ELSE 2 END
   WHEN last_year IS NULL THEN 5 WHEN year(DATE '{TODAY}') - last_year <= 0 THEN 7 WHEN year(DATE '{TODAY}') - last_year = 1 THEN 5 ELSE 4 END::DOUBLE AS freshness,
  CASE WHEN {WC} = 0 THEN 0 ELSE least(10, 5 + CASE WHEN {WC} >= 50 THEN 2 ELSE 0 END + CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN author <> '' THEN 0.5 ELSE 0 END + CASE WHEN date <> '' THEN 0.5 ELSE 0 END + CASE WHEN {KPN} >= 5 THEN 1 ELSE 0 END) END::DOUBLE AS accessibility
 FROM pg JOIN ad USING (page_id) LEFT JOIN kn USING (page_id) LEFT JOIN known a ON a.kd = domain LEFT JOIN known b ON b.kd = regexp_extract(domain, '[^.]+\\.[^.]+$'))"""


def scored_pages(t):
    known = t.spark.createDataFrame(KNOWN, "domain string, score int")
    return E.score_sources(page_table(t), known, F.lit(TODAY).cast("date"))


@query("l06_source_score", f"WITH {SCORED} SELECT page_id, domain, reputation, substance, freshness, accessibility, round((3 * reputation + 2 * substance + 2 * freshness + accessibility) / 8, 2) AS composite FROM sc")
def _(t):
    s = scored_pages(t)
    cols = ("reputation", "substance", "freshness", "accessibility")
    return s.select("page_id", "domain", *cols, E.composite(cols).alias("composite"))


# Documents of one source and language block act as the result list of one question.
GROUPED = f"""{TERMS}, g AS (SELECT doc_id, concat(lang, '-', doc_id // 25) AS grp FROM documents), ts AS (SELECT grp, doc_id, list_sort(list(term)) AS s FROM kt JOIN g USING (doc_id) GROUP BY 1, 2),
jp AS (SELECT a.grp, a.doc_id, b.doc_id AS o, CASE WHEN b.doc_id IS NOT NULL THEN len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))) END AS j FROM ts a LEFT JOIN ts b ON a.grp = b.grp AND a.doc_id <> b.doc_id),
cs AS (SELECT grp, doc_id, avg(j) AS mean_overlap, coalesce(max(j), 0) AS max_overlap, CASE WHEN count(o) = 0 THEN 5 ELSE least(10, CASE WHEN round(avg(j), 12) >= 0.20 THEN 9 WHEN round(avg(j), 12) >= 0.12 THEN 7.5 WHEN round(avg(j), 12) >= 0.06 THEN 6 WHEN round(avg(j), 12) >= 0.03 THEN 4.5 ELSE 3 END
  + CASE WHEN max(j) >= 0.25 THEN 1 ELSE 0 END) END::DOUBLE AS consistency FROM jp GROUP BY 1, 2)"""


def grouped_terms(t):
    d = t.documents.withColumn("grp", F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 25).cast("string")))
    return T.key_terms(d, "doc_id", "text", keep=["grp"]).select("grp", "doc_id", "term")


@query("l07_consistency", f"""
WITH {GROUPED} SELECT grp, doc_id, round(mean_overlap, 8) AS mean_overlap, round(max_overlap, 8) AS max_overlap, consistency,
  count(*) OVER (PARTITION BY grp) >= 3 AND consistency < avg(consistency) OVER (PARTITION BY grp) - 3 AS outlier FROM cs""")
def _(t):
    return rounded(E.consistency(grouped_terms(t), "grp", "doc_id"), 8, "mean_overlap", "max_overlap")


@query("l08_extract_claims", f"WITH {ABSTRACT_CLAIMS} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, claim, value, unit, direction, round(confidence, 4) AS confidence FROM cl")
def _(t):
    return rounded(T.extract_claims(abstracts(t), "p_partkey", "text"), 4, "confidence")


@query("l08_document_claims", f"""
WITH ss AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, {Q.sentences('text')} AS l FROM documents)), cl AS ({Q.claims('ss', 'doc_id')})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(claim) AS claim, value, unit, direction, round(confidence, 4) AS confidence FROM cl""")
def _(t):
    return rounded(T.extract_claims(t.documents, "doc_id", "text"), 4, "confidence").withColumn("claim", F.md5("claim"))


WEB = f"""kp AS ({Q.key_paragraphs('documents', 'doc_id', 'text')}), sn AS (SELECT doc_id, rank, unnest(l) AS s0, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, rank, {Q.plain_sentences('p')} AS l FROM kp)),
so AS (SELECT doc_id, s0, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS pos FROM sn), cn AS (SELECT doc_id, pos, {Q.cleanup('s0')} AS s FROM so),
inf AS (SELECT doc_id, pos, s, round({Q.informativeness('s')}, 6) AS inf FROM cn WHERE NOT {Q.rejected('s')}), ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY inf DESC, pos) AS o FROM inf WHERE inf >= 1),
wc AS (SELECT doc_id, s, inf, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rank FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc_id = a.doc_id AND b.o < a.o AND contains(b.s, a.s)) QUALIFY rank <= 20)"""


def document_claims(t):
    return T.web_claims(t.documents, "doc_id", "text")


@query("l09_web_claims", f"WITH {WEB} SELECT doc_id, CAST(rank AS INTEGER) AS rank, md5(s) AS claim, inf AS informativeness FROM wc")
def _(t):
    return document_claims(t).withColumn("claim", F.md5("claim"))


PAIR_TERMS = f"""dt AS (SELECT doc_id, lang, list_sort(list_filter(list_distinct({Q.words_of('text')}), lambda w: NOT list_contains({Q.words_list(L.CLAIM_STOP_WORDS)}, w))) AS s FROM documents),
fs AS (SELECT lang, s, min(doc_id) AS doc_id FROM dt WHERE len(s) > 0 GROUP BY 1, 2),
pr AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM fs a JOIN fs b ON a.lang = b.lang AND a.doc_id < b.doc_id
  AND least(len(a.s), len(b.s)) > 0.6 * greatest(len(a.s), len(b.s)))"""


@query("l10_dedup_near", f"""
WITH RECURSIVE {PAIR_TERMS}, w AS (SELECT doc_id, lang, (SELECT list(a) FROM pr WHERE b = fs.doc_id AND j > 0.6) AS ws, row_number() OVER (ORDER BY doc_id) AS r FROM fs),
g(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.r, CASE WHEN ws IS NULL OR NOT list_has_any(kept, ws) THEN list_append(kept, doc_id) ELSE kept END FROM g JOIN w ON w.r = g.r + 1),
k AS (SELECT unnest(kept) AS doc_id FROM g WHERE r = (SELECT count(*) FROM w)) SELECT doc_id, lang FROM documents JOIN k USING (doc_id)""")
def _(t):
    kept = E.dedup_near(t.documents.select("doc_id", "lang", "text"), ["lang"], "doc_id", "text")
    return kept.select("doc_id", "lang")


@query("l10_similar_pairs", f"WITH {PAIR_TERMS} SELECT lang, a, b, round(j, 8) AS jaccard FROM pr WHERE j > 0.6")
def _(t):
    d = t.documents.select("doc_id", "lang", T.claim_terms(F.col("text")).alias("s")).filter(F.size("s") > 0)
    firsts = d.groupBy("lang", "s").agg(F.min("doc_id").alias("doc_id"))
    return rounded(E.jaccard_pairs(firsts, ["lang"], "doc_id", "s", 0.6), 8, "jaccard")


# Claims of one brand are the evidence for one question; its words are the brand and type names.
THEME = f"""{ABSTRACT_CLAIMS}, qc AS (SELECT p_brand AS question, p_partkey * 10 + pos AS cid, claim FROM cl JOIN part USING (p_partkey)),
ct AS (SELECT question, cid, unnest(list_filter(list_distinct({Q.words_of('claim')}), lambda w: NOT list_contains({Q.words_list(L.CLAIM_STOP_WORDS)}, w))) AS term FROM qc),
nn AS (SELECT question, count(DISTINCT cid) AS n FROM ct GROUP BY 1), df AS (SELECT question, term, count(*) AS df FROM ct GROUP BY 1, 2),
di AS (SELECT question, term, df FROM df JOIN nn USING (question) WHERE df <= n * 0.6 AND term NOT IN ('brand', 'price', 'widget')),
us AS (SELECT ct.* FROM ct JOIN di USING (question, term) WHERE df >= 2),
co AS (SELECT a.question, a.term AS t1, b.term AS t2, count(*) AS n FROM us a JOIN us b ON a.question = b.question AND a.cid = b.cid AND a.term < b.term GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def theme_parts(t):
    """Claims, their terms and the distinctive ones. Claims and distinctive terms are written, so that claims are made once and
    joins go by true sizes: a plan that estimates claims from the part file would broadcast them all."""
    c = T.extract_claims(abstracts(t), "p_partkey", "text", keep=["p_brand"])
    c = stored(c.select(F.col("p_brand").alias("question"), (F.col("p_partkey") * 10 + F.col("pos")).alias("cid"), "p_partkey", "claim", "confidence"))
    terms = E.term_frequency(c, "question", "cid", "claim")
    asked = c.select("question").distinct().select("question", F.explode(F.array(F.lit("brand"), F.lit("price"), F.lit("widget"))).alias("term"))
    return c, terms, stored(E.distinctive_terms(terms, "question", "cid", asked))


@query("l11_distinctive_terms", f"WITH {THEME} SELECT question, term, df FROM di")
def _(t):
    return theme_parts(t)[2]


@query("l11_cooccurrence", f"WITH {THEME} SELECT question, t1, t2, n FROM co")
def _(t):
    _, terms, dist = theme_parts(t)
    return E.cooccurrence(terms, dist, "question", "cid")


# One step of theme growth a round: a theme is opened, takes one more pair, or is closed.
GROWN = f"""{THEME}, tp AS (SELECT question, t1, t2, row_number() OVER (PARTITION BY question ORDER BY n DESC, t1, t2) AS r FROM co QUALIFY r <= 60),
te AS (SELECT question, list({{'r': r, 'a': t1, 'b': t2}} ORDER BY r) AS e FROM tp GROUP BY 1),
sl AS (SELECT question, list(term ORDER BY r) AS s FROM (SELECT question, term, row_number() OVER (PARTITION BY question ORDER BY df DESC, term) AS r FROM di WHERE df >= 2 QUALIFY r <= 16) GROUP BY 1),
gr AS (SELECT question, coalesce(e, []) AS e, s, []::VARCHAR[] AS used, []::VARCHAR[] AS m, 0::BIGINT AS last, []::VARCHAR[][] AS th, FALSE AS done FROM sl LEFT JOIN te USING (question)
 UNION ALL SELECT question, e, s, CASE WHEN len(m) > 0 AND nx IS NULL THEN list_concat(used, m) ELSE used END,
  CASE WHEN nx IS NULL THEN [] WHEN len(m) = 0 THEN [nx.a, nx.b] ELSE list_append(m, CASE WHEN list_contains(m, nx.a) THEN nx.b ELSE nx.a END) END,
  CASE WHEN len(m) = 0 OR nx IS NULL THEN 0 ELSE nx.r END, CASE WHEN len(m) > 0 AND nx IS NULL THEN list_append(th, m) ELSE th END, len(m) = 0 AND nx IS NULL
 FROM (SELECT *, CASE WHEN len(m) = 0 AND len(th) < 8 THEN list_filter(e, lambda x: x.r <= 30 AND NOT list_contains(used, x.a) AND NOT list_contains(used, x.b))[1]
   WHEN len(m) BETWEEN 2 AND 5 THEN list_filter(e, lambda x: x.r > last AND list_contains(m, x.a) <> list_contains(m, x.b) AND NOT list_contains(used, CASE WHEN list_contains(m, x.a) THEN x.b ELSE x.a END))[1] END AS nx
  FROM gr WHERE NOT done)),
tt AS (SELECT question, CASE WHEN len(th) < 3 THEN list_concat(th, list_transform(list_filter(s, lambda x: NOT list_contains(used, x)), lambda x: [x])[1:8 - len(th)]) ELSE th END AS th FROM gr WHERE done),
tx AS (SELECT question, theme, unnest(ts) AS term FROM (SELECT question, unnest(range(1, len(th) + 1)) AS theme, unnest(th) AS ts FROM tt)),
bt AS (SELECT question, cid, theme FROM (SELECT question, cid, theme, count(*) AS o FROM ct JOIN tx USING (question, term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question, cid ORDER BY o DESC, theme) = 1),
asg AS (SELECT c.question, c.cid, coalesce(theme, 0) AS theme FROM (SELECT DISTINCT question, cid FROM ct) c LEFT JOIN bt ON bt.question = c.question AND bt.cid = c.cid)"""


@query("l11_theme_terms", f"WITH RECURSIVE {GROWN} SELECT question, theme, term FROM tx")
def _(t):
    _, terms, dist = theme_parts(t)
    return E.grow_themes(E.cooccurrence(terms, dist, "question", "cid"), dist, "question")


@query("l11_themes", f"""
WITH RECURSIVE {GROWN}, qf AS (SELECT p_brand AS question, p_partkey * 10 + pos AS cid, p_partkey, confidence FROM cl JOIN part USING (p_partkey))
SELECT question, theme, count(*) AS n_claims, count(DISTINCT p_partkey) AS n_sources, round(avg(confidence), 6) AS mean_score,
  round(2.0 * count(DISTINCT p_partkey) + avg(confidence) + 0.5 * least(count(*), 5), 6) AS evidence FROM asg JOIN qf USING (question, cid) GROUP BY 1, 2""")
def _(t):
    c, terms, dist = theme_parts(t)
    themes = E.grow_themes(E.cooccurrence(terms, dist, "question", "cid"), dist, "question")
    assigned = E.assign_themes(terms, themes, "question", "cid").join(c.hint("merge"), ["question", "cid"])
    return rounded(E.theme_strength(assigned, "question", "p_partkey", "confidence"), 6, "mean_score", "evidence")


FINDINGS = ["Prices of small rings increased 12.5 mm/yr since 1995", "Stock of economy markets declined", "Demand in towns 30 %"]


def parsed_sql() -> str:
    rows = [(0, 12.5, "'increase'"), (1, "NULL", "'decrease'"), (2, 30.0, "NULL")]
    words = [["prices", "small", "rings", "mm", "yr", "since"], ["stock", "economy", "markets"], ["demand", "towns"]]
    return "fd(finding, fv, fd, kw) AS (VALUES " + ", ".join(f"({i}, {v}, {d}, {Q.words_list(w)})" for (i, v, d), w in zip(rows, words)) + ")"


@query("l12_match_findings", f"""
WITH {ABSTRACT_CLAIMS}, {parsed_sql()}, mw AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-zA-Z]+')), lambda w: length(w) > 1 AND NOT list_contains({Q.words_list(L.FINDING_STOP_WORDS)}, w)) AS cw FROM cl, fd),
ms AS (SELECT finding, p_partkey, pos, claim, round(least(1, 0.5 * len(list_intersect(kw, cw)) / len(kw) + 0.3 * CASE WHEN fv IS NOT NULL AND value IS NOT NULL AND greatest(abs(fv), abs(value)) > 0 THEN pow(greatest(1 - abs(fv - value) / greatest(abs(fv), abs(value)), 0), 3)
   WHEN fv IS NULL AND value IS NULL THEN 0.5 ELSE 0.2 END + 0.2 * CASE WHEN fd = direction THEN 1 WHEN fd IS NOT NULL AND direction IS NOT NULL THEN 0 WHEN fd IS NULL AND direction IS NULL THEN 0.5 ELSE 0.3 END), 6) AS score,
  CASE WHEN fd IS NULL AND direction IS NULL THEN 'unclear' WHEN fd IS NULL OR direction IS NULL THEN 'related' WHEN fd <> direction THEN 'disagrees'
   WHEN fv IS NOT NULL AND value IS NOT NULL AND abs(fv - value) / greatest(abs(fv), abs(value)) > 0.5 THEN 'related' ELSE 'agrees' END AS agreement FROM mw)
SELECT finding, p_partkey, CAST(pos AS INTEGER) AS pos, claim, score::DOUBLE AS score, agreement, CAST(row_number() OVER (PARTITION BY finding ORDER BY score DESC, p_partkey, pos) AS INTEGER) AS rank FROM ms QUALIFY rank <= 20""")
def _(t):
    claims = T.extract_claims(abstracts(t), "p_partkey", "text")
    return E.match_findings(claims, FINDINGS, ["p_partkey", "pos"], 20)


TRUST = "|".join(h.replace(".", r"\.") for h in L.TRUSTED_HOSTS)


@query("l13_relevance", f"""
WITH {PAGE_SQL}, q AS (SELECT ['the', 'edition', 'of', 'ention', 'that', 'er'] AS qt), o AS (SELECT page_id, domain, page_id % 11 AS rk, len(list_intersect(qt, list_distinct({Q.words_of('title', '^[a-z]+$')}))) / 6.0 AS a,
  len(list_intersect(qt, list_distinct({Q.words_of('text', '^[a-z]+$')}))) / 6.0 AS b FROM pg, q)
SELECT page_id, round(least(10, CASE WHEN rk <= 2 THEN 3 WHEN rk <= 5 THEN 2 WHEN rk <= 8 THEN 1 ELSE 0.5 END + 3 * a + 2.5 * b + CASE WHEN regexp_matches(domain, {Q.q(TRUST)}) THEN 1.5 WHEN domain LIKE '%.org' THEN 0.5 ELSE 0 END), 6)::DOUBLE AS relevance FROM o""")
def _(t):
    p = page_table(t)
    terms = E.question_terms(F.lit("The edition of ention that er"))
    return p.select("page_id", F.round(E.relevance(terms, F.col("page_id") % 11, F.col("title"), F.col("text"), F.col("domain")), 6).alias("relevance"))


@query("l14_latest_per_key", """
SELECT regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '/+$', '') AS url_key, max(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1""")
def _(t):
    key = E.url_key(F.regexp_replace("url", "[?#].*$", "")).alias("url_key")
    return t.pages.groupBy(key).agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("l14_latest_page", """
SELECT url_key, page_id, url FROM (SELECT page_id, url, regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '/+$', '') AS url_key FROM pages)
QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id DESC) = 1""")
def _(t):
    p = t.pages.select("page_id", "url")
    key = E.url_key(F.regexp_replace("url", "[?#].*$", ""))
    return E.latest_per_key(p, key, [-F.col("page_id")], "url_key").select("url_key", "page_id", "url")


@query("l15_keyword_match", """
WITH m AS (SELECT p_partkey, list_sort(list_filter([CASE WHEN contains(lower(p_name), 'ring') THEN 'name:ring' END, CASE WHEN contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring') THEN 'kw:ring' END,
  CASE WHEN contains(lower(p_name), 'eco') THEN 'name:eco' END, CASE WHEN contains(lower(p_type), 'eco') OR contains(lower(p_brand), 'eco') THEN 'kw:eco' END,
  CASE WHEN contains(lower(p_name), 'brand#1') THEN 'name:brand#1' END, CASE WHEN contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1') THEN 'kw:brand#1' END], lambda x: x IS NOT NULL)) AS h FROM part)
SELECT p_partkey, array_to_string(h, '|') AS matched FROM m WHERE len(h) > 0""")
def _(t):
    p = t.part.select("p_partkey", "p_name", F.array("p_type", "p_brand").alias("kws"))
    return E.keyword_match(p, "p_name", "kws", ["ring", "eco", "brand#1"]).select("p_partkey", F.concat_ws("|", "matched").alias("matched"))


@query("l16_title_mapping", """
WITH tt AS (SELECT DISTINCT p_name AS title, length(p_name) % 2 = 0 AS redirect, length(p_name) % 5 = 0 AS dis FROM part),
c AS (SELECT p_partkey, unnest([p_type, split_part(p_name, ' ', 2), p_name]) AS kw, unnest([0, 1, 2]) AS prio FROM part), h AS (SELECT p_partkey, kw, prio, upper(title) AS title, redirect FROM c JOIN tt ON lower(kw) = lower(title) WHERE NOT dis)
SELECT p_partkey, arg_min(kw, prio) AS keyword, arg_min(title, prio) AS title, CASE WHEN arg_min(redirect, prio) THEN 'keyword_redirect' ELSE 'keyword_direct' END AS method FROM h GROUP BY 1""")
def _(t):
    titles = t.part.select(F.col("p_name").alias("title"), F.upper("p_name").alias("target"), (F.length("p_name") % 2 == 0).alias("redirect"), (F.length("p_name") % 5 == 0).alias("disambiguation")).distinct()
    topics = t.part.select("p_partkey", F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_name").alias("kws"))
    return E.title_mapping(topics, titles, "p_partkey", "kws")


POSITIVE, NEGATIVE = ["the", "and", "is", "le", "la", "die"], ["of", "to", "de", "der", "not"]


@query("l17_lexicon_sentiment", f"""
WITH w AS (SELECT conv_id, turn, {Q.words_of('text', '^[a-z]+$')} AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_filter(w, lambda x: x IN ('the', 'and', 'is', 'le', 'la', 'die'))) AS INTEGER) AS n_positive, CAST(len(list_filter(w, lambda x: x IN ('of', 'to', 'de', 'der', 'not'))) AS INTEGER) AS n_negative,
  round(coalesce((len(list_filter(w, lambda x: x IN ('the', 'and', 'is', 'le', 'la', 'die'))) - len(list_filter(w, lambda x: x IN ('of', 'to', 'de', 'der', 'not')))) * 1.0 / nullif(len(w), 0), 0), 8) AS sentiment FROM w""")
def _(t):
    return rounded(T.lexicon_sentiment(t.conversations, ["conv_id", "turn"], "text", POSITIVE, NEGATIVE), 8, "sentiment")


@query("l17_prior_similarity", f"""
WITH w AS (SELECT conv_id, turn, unnest({Q.words_of('text', '^[a-z]+$')}) AS term FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n FROM w GROUP BY 1, 2, 3), nm AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1, 2),
p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations), d AS (SELECT p.conv_id, p.turn, sum(a.n * b.n) AS dot FROM p JOIN c a ON a.conv_id = p.conv_id AND a.turn = p.turn JOIN c b ON b.conv_id = p.conv_id AND b.turn = p.prior AND a.term = b.term GROUP BY 1, 2)
SELECT p.conv_id, p.turn, p.prior, round(coalesce(dot / (a.norm * b.norm), 0), 8) AS similarity FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN nm a ON a.conv_id = p.conv_id AND a.turn = p.turn LEFT JOIN nm b ON b.conv_id = p.conv_id AND b.turn = p.prior WHERE prior IS NOT NULL""")
def _(t):
    return rounded(T.prior_similarity(t.conversations, "conv_id", "turn", "text"), 8, "similarity")


@query("l18_citation_label", """
SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN concat('"', substr(p_name, 1, 30), '"') WHEN 1 THEN upper(split_part(p_name, ' ', 2)) WHEN 2 THEN concat(upper(split_part(p_name, ' ', 2)), ' & Lee') ELSE concat(upper(split_part(p_name, ' ', 2)), ' et al.') END, ', ',
  CASE WHEN p_size % 3 = 0 THEN 'n.d.' ELSE CAST(1980 + p_size AS VARCHAR) END) AS label FROM part""")
def _(t):
    a = F.concat(F.lit("Ada "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))))
    k = F.col("p_partkey") % 4
    authors = (F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(a)).when(k == 2, F.array(a, F.lit("Bo Lee"))).otherwise(F.array(a, F.lit("Bo Lee"), F.lit("Cy Ray"))))
    year = F.when(F.col("p_size") % 3 != 0, 1980 + F.col("p_size"))
    return t.part.select("p_partkey", T.citation_label(authors, year, F.col("p_name")).alias("label"))
