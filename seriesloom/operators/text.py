"""Page extraction, cleaning, paragraphs, sentences, terms, claims and citation labels.

Everything that looks at one text stays inside the row as column expressions over the whole text: no shuffle and no
Python. Rows only split where the result has several rows per text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import wordlists as L

SEP = "\u0001"
DOT = "\u0002"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is worked out once a row however often `body` names it: a lambda binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(text: Column) -> Column:
    """The text, or NULL where it is empty."""
    return let(text, lambda t: F.when(t != "", t))


def first_filled(*tries: Column) -> Column:
    return F.coalesce(*[filled(strip(t)) for t in tries], F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


# ---- pages ---------------------------------------------------------------------------------------------------

def decode_entities(text: Column) -> Column:
    """Named entities of the fixed list and decimal character references."""

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(
            p.rlike(r"^\d{2,6};"),
            F.concat(F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, r"^(\d+);", 1).try_cast("bigint")), 8, "0")), "UTF-32"),
                     F.regexp_replace(p, r"^\d+;", ""))).otherwise(F.concat(F.lit("&#"), p)))
        first = F.get(parts, F.lit(0))
        return F.when(F.size(parts) > 1, F.concat(first, F.array_join(rest, ""))).otherwise(first)

    out = let(F.split(text, "&#", -1), joined)
    for name, plain in L.ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag in double, single or no quotes, empty when absent."""
    raw = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def meta_tags(html: Column) -> Column:
    """(name, property, content) of every meta tag in order, names in lower case."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<meta\s(?:"[^"]*+"|'[^']*+'|[^>"']++)*+>"""), F.lit(0))
    return F.transform(tags, lambda t: F.struct(
        F.lower(attribute(t, "name")).alias("name"), F.lower(attribute(t, "property")).alias("property"), attribute(t, "content").alias("content")))


def meta_content(metas: Column, names: Sequence[str]) -> list[Column]:
    """First filled content under each name, one expression per name."""

    def under(name: str) -> Column:
        return F.get(F.filter(metas, lambda m: ((m["name"] == name) | (m["property"] == name)) & (strip(m["content"]) != "")), F.lit(0))["content"]

    return [under(n.lower()) for n in names]


def _by_tag(html: Column, tag: str, body) -> Column:
    """`body` over pieces and depths: the text cut before every opening and closing tag of that name (the first piece
    has none), and the nesting depth reached before the first and after each piece's tag."""
    pieces = F.split(F.concat(F.lit(SEP), html), rf"(?i)(?=</?{tag}\b)", -1)
    change = F.transform(pieces, lambda p: F.when(p.startswith("</"), -1).when(p.startswith("<"), 1).otherwise(0))
    depths = F.aggregate(change, F.array(F.lit(0)), lambda seen, c: F.concat(seen, F.array(F.greatest(F.element_at(seen, -1) + c, F.lit(0)))))
    return let(F.struct(pieces.alias("pieces"), depths.alias("depths")), body)


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first element with the tag, elements of the same name inside it included; empty when absent or
    never closed. Depth is only counted where the tag occurs more than once."""

    def first(s: Column) -> Column:
        start = F.array_position(s["depths"], 1)  # one-based, so the piece of that tag is the one before
        stop = F.array_position(F.slice(s["depths"], start + 1, F.size(s["depths"])), 0)
        inner = F.array_join(F.slice(s["pieces"], F.greatest(start - 1, F.lit(1)).cast("int"), F.greatest(stop, F.lit(0)).cast("int")), "")
        return F.when((start > 0) & (stop > 0), F.regexp_replace(inner, r"^<[^>]*>", "")).otherwise("")

    once = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return let(F.regexp_count(html, F.lit(rf"(?i)<{tag}\b")), lambda n: F.when(n > 1, _by_tag(html, tag, first)).when(n == 0, "").otherwise(once))


def drop_element(html: Column, tag: str) -> Column:
    """The text without elements of that tag and what they hold; an element that is never closed stays."""

    def outside(s: Column) -> Column:
        last = F.size(s["depths"]) - F.array_position(F.reverse(s["depths"]), 0) + 1  # the last place at depth 0, one-based
        zipped = F.arrays_zip(s["pieces"].alias("p"), F.slice(s["depths"], 2, F.size(s["pieces"])).alias("d"))
        kept = F.filter(zipped, lambda z, i: (z["d"] == 0) | (i + 2 > last))
        return F.replace(F.array_join(F.transform(kept, lambda z: F.regexp_replace(z["p"], rf"(?i)^</{tag}\b[^>]*>", "")), ""), F.lit(SEP), F.lit(""))

    once = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return let(F.regexp_count(html, F.lit(rf"(?i)<{tag}\b")), lambda n: F.when(n > 1, _by_tag(html, tag, outside)).when(n == 0, html).otherwise(once))


def plain_text(html: Column, joiner: str) -> Column:
    """Text nodes in order, each stripped, joined by `joiner`, entities decoded."""
    cut = F.regexp_replace(html, r"(?s)<[^>]*>", SEP)
    nodes = F.regexp_replace(F.regexp_replace(cut, rf"\s*{SEP}[\s{SEP}]*", SEP), rf"^[\s{SEP}]+|[\s{SEP}]+$", "")
    return decode_entities(F.replace(nodes, F.lit(SEP), F.lit(joiner)))


def html_extract(pages: DataFrame, url: str = "url", html: str = "html", min_words: int = 50) -> DataFrame:
    """Domain, title, author, date, cleaned main text and word count of every page; `ok` needs `min_words` words.

    The main text is the first article, main or body element without scripts, navigation and other furniture.
    """
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    out = pages.withColumns({"__b": body, "__m": meta_tags(F.col(html))})
    for tag in L.DROPPED_ELEMENTS:
        # one projection per tag, so that no text is worked out twice; scripts and the like cannot nest
        nests = tag not in ("script", "style", "noscript", "iframe")
        out = out.withColumn("__b", drop_element(F.col("__b"), tag) if nests else F.regexp_replace("__b", rf"(?is)<{tag}\b.*?</{tag}\s*>", ""))
    main = F.coalesce(*[filled(element(F.col("__b"), t)) for t in L.MAIN_ELEMENTS], F.col("__b"))
    h, metas = F.col(html), F.col("__m")
    time_tag = attribute(F.regexp_extract(h, r"(?i)<time\b[^>]*\sdatetime\s*=[^>]*>", 0), "datetime")
    title = first_filled(*[decode_entities(c) for c in meta_content(metas, ["og:title"])], plain_text(element(h, "title"), " "), plain_text(element(h, "h1"), " "))
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://([^/?#]+)", 1))
    out = out.select(*pages.columns, F.regexp_replace(host, r"^www\.", "").alias("domain"), title.alias("title"),
                     first_filled(*meta_content(metas, L.AUTHOR_NAMES)).alias("author"),
                     first_filled(*meta_content(metas, L.DATE_NAMES), time_tag, plain_text(element(h, "time"), " ")).alias("date"),
                     clean_text(plain_text(main, "\n\n")).alias("text"))
    words = word_count(F.col("text"))
    return out.withColumns({"word_count": words, "ok": (words >= min_words) & (F.length(html) >= 100)})


def clean_text(text: Column) -> Column:
    """Line ends, trailing blanks, blank runs and furniture lines."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[^\S\n]+\n", "\n")

    def without_furniture(t: Column) -> Column:
        kept = t
        for pattern in L.BOILERPLATE:
            kept = F.regexp_replace(kept, rf"(?imd)^.*{pattern}.*$", "")
        first = "".join(sorted({pattern[0] for pattern in L.BOILERPLATE}))
        return F.when(t.rlike(rf"(?i)(?=[{first}])(?:{'|'.join(L.BOILERPLATE)})"), kept).otherwise(t)  # most texts have none

    t = let(t, without_furniture)
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# ---- paragraphs and sentences --------------------------------------------------------------------------------

def pieces(text: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(text, by, -1), strip), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, or single lines when there are at most two blocks."""
    blocks = pieces(text, "\n\n")
    return F.when(F.size(blocks) <= 2, pieces(text, "\n")).otherwise(blocks)


def paragraph_score(p: Column) -> Column:
    words = word_count(p)
    return (F.when(words.between(20, 100), 2).when(words > 100, 1).otherwise(0)
            + F.least(F.regexp_count(p, F.lit(r"\d+\.?\d*")), F.lit(3)) + F.when(p.rlike(r"20\d{2}"), 1).otherwise(0)
            + F.when(p.rlike(L.MONEY_MARKS), 2).otherwise(0) + F.when(p.rlike('["“]'), 1).otherwise(0))


def key_paragraphs(text: Column, k: int = 10, min_words: int = 10) -> Column:
    """The k best paragraphs as structs (rank order: score, then position), computed within the row."""
    scored = F.transform(paragraphs(text), lambda p, i: F.struct((-paragraph_score(p)).alias("neg"), i.alias("pos"), p.alias("text"),
                                                                 word_count(p).alias("words")))
    return F.slice(F.array_sort(F.filter(scored, lambda s: s["words"] >= min_words)), 1, k)


def sentences(text: Column) -> Column:
    """Sentences of a text as an array; abbreviations and decimals do not end one.

    Separators are inserted first and split on afterwards, so no look-around is needed. An abbreviation keeps only
    its closing stop.
    """
    t = text
    for a in L.ABBREVIATIONS:
        t = F.regexp_replace(t, "(?i)" + a.replace(".", r"\.") + r"\.", a.replace(".", "") + DOT)
    t = F.regexp_replace(t, r"(\d)\.(\d)", f"$1{DOT}$2")
    t = F.regexp_replace(t, r"([.!?])\s+([A-Z])", f"$1{SEP}$2")
    return pieces(F.replace(t, F.lit(DOT), F.lit(".")), SEP)


def plain_sentences(text: Column) -> Column:
    """Split after . ! ? before a capital, without protecting abbreviations."""
    return pieces(F.regexp_replace(text, r"([.!?])\s+([A-Z])", f"$1{SEP}$2"), SEP)


# ---- terms ---------------------------------------------------------------------------------------------------

def word_runs(text: Column) -> Column:
    """Whole runs of letters, digits and underscores in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words_of(text: Column, pattern: str = "^[a-z]{3,}$", distinct: bool = False) -> Column:
    """Lower-case words that fully match the pattern; a word is a whole run of letters, digits and underscores."""
    runs = word_runs(text)
    return F.filter(F.array_distinct(runs) if distinct else runs, lambda w: w.rlike(pattern))


def without(words: Column, stop_words: Sequence[str]) -> Column:
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]))


def key_terms(docs: DataFrame, row_id: str, text: str, n: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """The n most frequent terms of each text, ties by term: row_id, term, n, rank and the columns in `keep`.

    Terms are counted inside their row, as runs of the sorted words, so nothing is shuffled.
    """
    stop = L.TERM_STOP_WORDS
    rows = docs.select(row_id, *keep, F.array_sort(F.filter(words_of(F.col(text)), lambda w: ~w.isin(stop))).alias("__w"))
    size = F.size("__w")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    rows = rows.withColumn("__at", F.filter(places, lambda i: (i == 0) | (F.get("__w", i) != F.get("__w", i - 1))))
    ends = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(size))
    runs = F.zip_with("__at", ends, lambda i, j: F.struct((i - j).alias("neg"), F.get("__w", i).alias("term")))
    best = rows.select(row_id, *keep, F.posexplode(F.slice(F.array_sort(runs), 1, n)).alias("__r", "__t"))
    return best.select(row_id, *keep, F.col("__t.term").alias("term"), (-F.col("__t.neg")).cast("bigint").alias("n"), (F.col("__r") + 1).alias("rank"))


def claim_terms(text: Column) -> Column:
    """Distinct terms of a claim, sorted."""
    return F.array_sort(without(words_of(text, distinct=True), L.CLAIM_STOP_WORDS))


# ---- claims --------------------------------------------------------------------------------------------------

def direction(text: Column) -> Column:
    return (F.when(text.rlike(L.NO_CHANGE), "no change").when(text.rlike(L.INCREASE), "increase").when(text.rlike(L.DECREASE), "decrease"))


def extract_claims(docs: DataFrame, row_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One claim per distinct sentence of a text: its first value with unit, else its first percentage, else its first
    r or p statistic, else only a direction. Confidence 0.1 + 0.3 value + 0.2 unit + 0.1 direction. `keep` names further
    columns of a text that its claims carry."""
    s = docs.select(row_id, *keep, F.posexplode(sentences(F.col(text))).alias("pos", "claim"))
    s = s.groupBy(row_id, *keep, "claim").agg(F.min("pos").alias("pos"))
    def got(text: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    c, m = F.col("claim"), F.col("__m")
    found = {"direction": direction(c), "__vu": F.regexp_extract(c, L.VALUE_UNIT, 0), "__p": got(c, L.PERCENT, 1), "__st": F.regexp_extract(c, L.STATISTIC, 0)}
    # a row of one match list: filters stay above it, so every pattern runs once a sentence
    s = s.select(row_id, *keep, "pos", "claim", F.explode(F.array(F.struct(*[x.alias(n) for n, x in found.items()]))).alias("__m"))
    s = s.withColumns({"direction": m["direction"], "__v": got(m["__vu"], L.VALUE_UNIT, 1), "__u": got(m["__vu"], L.VALUE_UNIT, 2),
                       "__p": m["__p"], "__s": got(m["__st"], L.STATISTIC, 1), "__sv": got(m["__st"], L.STATISTIC, 3)}).filter(
        (m["__vu"] != "") | m["__p"].isNotNull() | (m["__st"] != "") | m["direction"].isNotNull())
    is_unit, is_pct, is_stat = F.col("__v").isNotNull(), F.col("__p").isNotNull(), F.col("__s").isNotNull()
    s = s.withColumns({
        "value": F.coalesce("__v", "__p", "__sv").cast("double"),
        "unit": F.when(is_unit, strip(F.col("__u"))).when(is_pct, "%").when(is_stat, F.concat(F.lower("__s"), F.lit("-value"))),
        "__plain_stat": ~is_unit & ~is_pct & is_stat})
    has_unit = F.col("unit").isNotNull() & ~F.col("__plain_stat")
    score = (F.lit(0.1) + F.when(F.col("value").isNotNull(), 0.3).otherwise(0.0) + F.when(has_unit, 0.2).otherwise(0.0)
             + F.when(F.col("direction").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("__plain_stat"), 0.1).otherwise(0.0))
    return s.select(row_id, *keep, "pos", "claim", "value", "unit", "direction", F.least(score, F.lit(0.95)).alias("confidence"))


def informativeness(s: Column) -> Column:
    words = word_count(s)
    proper = F.regexp_count(F.regexp_replace(s, r"\. [A-Z]", ". "), F.lit("[A-Z][a-z]{2,}"))
    return (F.least(F.lit(3.0), F.regexp_count(s, F.lit(r"\b\d[\d,.]*\b")) * 0.5) + F.least(F.lit(2.0), F.regexp_count(s, F.lit(L.CLAIM_MARKS)) * 0.7)
            + F.when(s.rlike(r"\b20[12]\d\b"), 1.0).otherwise(0.0) + F.least(F.lit(1.0), proper * 0.2)
            + F.when(words >= 30, 1.0).when(words >= 20, 0.5).otherwise(0.0) + F.when(s.rlike(L.ANALYTIC_MARKS), 1.0).otherwise(0.0))


def rejected(s: Column) -> Column:
    """True for sentences that match a reject pattern with all its limits, or have no verb and few words.

    Patterns without limits are tested as two alternations, which keeps the generated code small.
    """
    words, commas = word_count(s), F.regexp_count(s, F.lit(","))
    limits = {"words_below": lambda n: words < n, "words_at_most": lambda n: words <= n, "commas_above": lambda n: commas > n,
              "commas_at_least": lambda n: commas >= n, "also": lambda p: s.rlike(p)}
    plain = [f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p, lim in L.CLAIM_REJECTS if not lim]
    # those for the beginning of a sentence are behind one anchor, so that they are not tried at each place
    at_start = [p.replace("^", "", 1) for p in plain if p.startswith(("(?i:^", "(?:^"))]
    anywhere = [p for p in plain if not p.startswith(("(?i:^", "(?:^"))]
    out = ((words < L.MIN_CLAIM_WORDS) | (words > L.MAX_CLAIM_WORDS) | ((words <= 10) & ~s.rlike(L.CLAIM_VERBS))
           | s.rlike(f"^(?:{'|'.join(at_start)})") | s.rlike("|".join(anywhere)))
    for pattern, lim in L.CLAIM_REJECTS:
        if lim:
            hit = s.rlike(pattern)
            for name, bound in lim.items():
                hit = hit & limits[name](bound)
            out = out | hit
    return out


def web_claims(docs: DataFrame, row_id: str, text: str, per_source: int = 20, min_score: float = 1.0, extra: Sequence[str] = ()) -> DataFrame:
    """Informative sentences from the key paragraphs of each source, at most `per_source`, best first.

    A sentence contained in a better one of the same source is left out. Both lists are bounded by the ten key
    paragraphs of a source and stay inside its row.
    """
    def cleaned(pattern: str, plain: str, mark: str):
        return lambda c: F.when(c.rlike(mark), strip(F.regexp_replace(c, pattern, plain))).otherwise(c)

    # cleaned inside the array: a filter above the explode then cannot repeat the clean-up per condition
    sents = F.transform(F.flatten(F.transform(key_paragraphs(F.col(text)), lambda p: plain_sentences(p["text"]))), strip)
    for (pattern, plain), mark in zip(L.CLAIM_CLEANUP, L.CLAIM_CLEANUP_MARKS, strict=True):
        # a pass of its own, as most sentences lack the mark without which the pattern cannot match
        sents = F.transform(sents, cleaned(pattern, plain, mark))
    rows = docs.select(row_id, *extra, F.posexplode(sents).alias("pos", "claim"))
    rows = rows.filter(~rejected(F.col("claim"))).withColumn("informativeness", F.round(informativeness(F.col("claim")), 6))
    rows = rows.filter(F.col("informativeness") >= min_score)
    best = F.array_sort(F.collect_list(F.struct((-F.col("informativeness")).alias("neg"), "pos", "claim")))
    kept = F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y["claim"].contains(x["claim"])))
    grouped = rows.groupBy(row_id, *extra).agg(best.alias("all"))
    top = grouped.select(row_id, *extra, F.posexplode(F.slice(kept, 1, per_source)).alias("rank", "c"))
    return top.select(row_id, *extra, (F.col("rank") + 1).alias("rank"), F.col("c.claim").alias("claim"), (-F.col("c.neg")).alias("informativeness"))


def citation_label(authors: Column, year: Column, title: Column) -> Column:
    """'A', 'A & B' or 'A et al.' with the year, else the start of the title."""
    when = F.coalesce(year.cast("string"), F.lit("n.d."))

    def last(i: int) -> Column:
        return F.element_at(F.split(strip(F.get(authors, F.lit(i))), r"\s+"), -1)

    first = F.when(F.get(authors, F.lit(0)) == "", "Unknown").otherwise(last(0))
    names = F.when(F.size(authors) == 1, first).when(F.size(authors) == 2, F.concat(first, F.lit(" & "), last(1))).otherwise(F.concat(first, F.lit(" et al.")))
    short = F.concat(F.lit('"'), F.substring(title, 1, 30), F.when(F.length(title) > 30, "...").otherwise(""), F.lit('"'))
    return F.concat(F.when(F.coalesce(F.size(authors), F.lit(0)) < 1, short).otherwise(names), F.lit(", "), when)


def lexicon_sentiment(docs: DataFrame, keys: Sequence[str], text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """(positive - negative) / words per text from word counts inside the row. The exact formula is our choice."""
    words = words_of(F.col(text), "^[a-z]+$")

    def hits(lexicon: Sequence[str]) -> Column:
        return F.size(F.filter("__w", lambda w: w.isin(*lexicon)))

    out = docs.select(*keys, words.alias("__w")).select(*keys, F.size("__w").alias("n_words"), hits(positive).alias("n_positive"), hits(negative).alias("n_negative"))
    return out.withColumn("sentiment", F.coalesce(F.try_divide((F.col("n_positive") - F.col("n_negative")).cast("double"), F.col("n_words").cast("double")), F.lit(0.0)))


def prior_similarity(docs: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Cosine of term counts between each text and the previous one of its group (0 without common terms)."""
    from seriesloom.operators.split import join_keys, neighbours
    prev = neighbours(docs.select(group, order), [group], order, before={order: "prior"}).filter(F.col("prior").isNotNull())
    terms = docs.select(group, order, F.explode(words_of(F.col(text), "^[a-z]+$")).alias("term")).groupBy(group, order, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norms = terms.groupBy(group, order).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    mine = join_keys(terms, prev, [group, order])
    other = terms.select(group, F.col(order).alias("prior"), "term", F.col("n").alias("m"))
    dot = join_keys(mine, other, [group, "prior", "term"]).groupBy(group, order).agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    out = join_keys(join_keys(prev, norms, [group, order], "left"), norms.withColumnsRenamed({order: "prior", "norm": "prior_norm"}), [group, "prior"], "left")
    out = join_keys(out, dot, [group, order], "left")
    cos = F.try_divide(F.col("dot"), F.col("norm") * F.col("prior_norm"))
    return out.select(group, order, "prior", F.coalesce(cos, F.lit(0.0)).alias("similarity"))
