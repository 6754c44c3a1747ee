"""SQL twins of the text expressions, generated from the same fixed word lists and patterns."""

import re

from seriesloom.functions import wordlists as L

EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def rx(pattern: str) -> str:
    """The pattern with word edges that know non-ASCII letters, for existence tests."""
    head = re.match(r"(\(\?i\))?\\b", pattern)
    if head:
        pattern = (head.group(1) or "") + EDGE_L + pattern[head.end():]
    return pattern.replace(r"\b", EDGE_R)


def sub(x: str, pattern: str, plain: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {plain}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(rx(pattern))})"


def pieces(x: str, by: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {by}), lambda p_: {strip('p_')}), lambda p_: p_ <> '')"


def sentences(x: str) -> str:
    for a in L.ABBREVIATIONS:
        x = sub(x, "(?i)" + a.replace(".", r"\.") + r"\.", f"concat({q(a.replace('.', ''))}, chr(2))")
    x = sub(x, r"(\d)\.(\d)", r"concat('\1', chr(2), '\2')")
    x = sub(x, r"([.!?])\s+([A-Z])", r"concat('\1', chr(1), '\2')")
    return pieces(f"replace({x}, chr(2), '.')", "chr(1)")


def plain_sentences(x: str) -> str:
    return pieces(sub(x, r"([.!?])\s+([A-Z])", r"concat('\1', chr(1), '\2')"), "chr(1)")


def clean_text(x: str) -> str:
    x = sub(f"replace({x}, chr(13) || chr(10), chr(10))", r"\n{3,}", "chr(10) || chr(10)")
    x = sub(x, r"[^\S\n]+\n", "chr(10)")
    for p in L.BOILERPLATE:
        x = sub(x, rf"(?im)^.*{p}.*$")
    return strip(sub(x, r"\n{3,}", "chr(10) || chr(10)"))


def element(x: str, tag: str) -> str:
    return f"regexp_extract({x}, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}>')}, 1)"


def plain_text(x: str, joiner: str) -> str:
    x = sub(x, r"(?s)<[^>]*>", "chr(1)")
    x = sub(sub(x, r"\s*\x01[\s\x01]*", "chr(1)"), r"^[\s\x01]+|[\s\x01]+$")
    for name, plain in L.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(plain)})"
    return f"replace({x}, chr(1), {joiner})"


META_TAG = r"""(?i)<meta\s(?:"[^"]*"|'[^']*'|[^>"'])*>"""
TIME_TAG = r"(?i)<time\b[^>]*\sdatetime\s*=[^>]*>"


def attribute(tag: str, name: str) -> str:
    found = f"regexp_extract({tag}, {q(rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")}, 1)"
    return sub(found, r"""^["']|["']$""")


def meta_content(metas: str, name: str) -> str:
    """First filled content of the meta tags under a name."""
    return f"list_filter({metas}, lambda m: (m.name = {q(name.lower())} OR m.property = {q(name.lower())}) AND {strip('m.content')} <> '')[1].content"


def first_filled(tries) -> str:
    return f"coalesce({', '.join(f"nullif({strip(t)}, '')" for t in tries)}, '')"


#: The formats of `functions.scalars.DATE_FORMATS` in the same order.
DATE_FORMATS = [(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d{4}", "%Y-%m-%dT%H:%M:%S%z"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", "%Y-%m-%dT%H:%M:%SZ"),
                (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "%Y-%m-%dT%H:%M:%S"), (r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"[A-Za-z]+ \d{1,2}, \d{4}", "%B %d, %Y"),
                (r"[A-Za-z]+ \d{1,2}, \d{4}", "%b %d, %Y"), (r"\d{1,2} [A-Za-z]+ \d{4}", "%d %B %Y"), (r"\d{1,2} [A-Za-z]+ \d{4}", "%d %b %Y"),
                (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"), (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y")]


def any_date_epoch(x: str) -> str:
    """Seconds of `functions.scalars.parse_any_date`, sessions in UTC."""
    tries = [f"CASE WHEN regexp_full_match(trim({x}), {q(shape)}) THEN epoch(try_strptime(trim({x}), {q(form)})) END" for shape, form in DATE_FORMATS]
    return f"coalesce({', '.join(tries)}, epoch(try_strptime(nullif(regexp_extract(trim({x}), '\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''), '%Y-%m-%d')))"


def drop_elements(x: str) -> str:
    x = sub(x, r"(?s)<!--.*?-->")
    for tag in L.DROPPED_ELEMENTS:
        x = sub(x, rf"(?is)<{tag}\b.*?</{tag}>")
    return x


def words_of(x: str, pattern: str = "^[a-z]{3,}$") -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w_: regexp_matches(w_, {q(pattern)}))"


def paragraph_score(p: str) -> str:
    w = count(p, r"\S+")
    return (f"(CASE WHEN {w} BETWEEN 20 AND 100 THEN 2 WHEN {w} > 100 THEN 1 ELSE 0 END + least({count(p, r'\d+\.?\d*')}, 3)"
            f" + CASE WHEN regexp_matches({p}, '20\\d{{2}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({p}, {q(L.MONEY_MARKS)}) THEN 2 ELSE 0 END"
            f" + CASE WHEN regexp_matches({p}, '[\"“]') THEN 1 ELSE 0 END)")


def key_paragraphs(table: str, row_id: str, text: str, where: str = "TRUE", k: int = 10) -> str:
    """CTE body: row_id, pos, rank, p (paragraph), score."""
    blocks, lines = pieces(text, "chr(10) || chr(10)"), pieces(text, "chr(10)")
    return (f"SELECT *, row_number() OVER (PARTITION BY {row_id} ORDER BY score DESC, pos) AS rank FROM (SELECT {row_id}, pos, p, {paragraph_score('p')} AS score FROM ("
            f"SELECT {row_id}, unnest(ps) AS p, unnest(range(0, len(ps))) AS pos FROM (SELECT {row_id}, CASE WHEN len(b) <= 2 THEN l ELSE b END AS ps FROM "
            f"(SELECT {row_id}, {blocks} AS b, {lines} AS l FROM {table} WHERE {where}))) WHERE {count('p', r'\S+')} >= 10) QUALIFY rank <= {k}")


def claims(source: str, keys: str, s: str = "s", pos: str = "pos") -> str:
    """CTE body over distinct sentences: value, unit, direction, confidence."""
    vu, pc, st = L.VALUE_UNIT, L.PERCENT, L.STATISTIC

    def got(p: str, g: int) -> str:
        return f"nullif(regexp_extract({s}, {q(p)}, {g}), '')"

    return (f"SELECT {keys}, {pos}, {s} AS claim, CAST(coalesce(v, pct, sv) AS DOUBLE) AS value, CASE WHEN v IS NOT NULL THEN {strip('u')} WHEN pct IS NOT NULL THEN '%' WHEN st IS NOT NULL THEN lower(st) || '-value' END AS unit,"
            f" dir AS direction, least(0.95, 0.1 + CASE WHEN coalesce(v, pct, sv) IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN v IS NOT NULL OR pct IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN dir IS NOT NULL THEN 0.1 ELSE 0 END"
            f" + CASE WHEN v IS NULL AND pct IS NULL AND st IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM (SELECT {keys}, {pos}, {s}, {got(vu, 1)} AS v, {got(vu, 2)} AS u, {got(pc, 1)} AS pct, {got(st, 1)} AS st, {got(st, 3)} AS sv,"
            f" CASE WHEN {has(s, L.NO_CHANGE)} THEN 'no change' WHEN {has(s, L.INCREASE)} THEN 'increase' WHEN {has(s, L.DECREASE)} THEN 'decrease' END AS dir"
            f" FROM (SELECT {keys}, {s}, min({pos}) AS {pos} FROM {source} GROUP BY {keys}, {s})) WHERE coalesce(v, pct, sv) IS NOT NULL OR dir IS NOT NULL")


def cleanup(x: str) -> str:
    for pattern, plain in L.CLAIM_CLEANUP:
        x = strip(sub(x, pattern, q(plain.replace("$", "\\"))))
    return x


def rejected(s: str) -> str:
    w, c = count(s, r"\S+"), count(s, ",")
    out = [f"{w} < {L.MIN_CLAIM_WORDS}", f"{w} > {L.MAX_CLAIM_WORDS}", f"({w} <= 10 AND NOT {has(s, L.CLAIM_VERBS)})"]
    for pattern, lim in L.CLAIM_REJECTS:
        hit = has(s, pattern)
        for key, cond in (("words_below", f"{w} <"), ("words_at_most", f"{w} <="), ("commas_above", f"{c} >"), ("commas_at_least", f"{c} >=")):
            if key in lim:
                hit += f" AND {cond} {lim[key]}"
        if "also" in lim:
            hit += f" AND {has(s, lim['also'])}"
        out.append(f"({hit})")
    return "(" + " OR ".join(out) + ")"


def informativeness(s: str) -> str:
    w = count(s, r"\S+")
    proper = count(sub(s, r"\. [A-Z]", "'. '"), "[A-Z][a-z]{2,}")
    return (f"(least(3.0, {count(s, r'\b\d[\d,.]*\b')} * 0.5) + least(2.0, {count(s, L.CLAIM_MARKS)} * 0.7) + CASE WHEN {has(s, r'\b20[12]\d\b')} THEN 1.0 ELSE 0.0 END"
            f" + least(1.0, {proper} * 0.2) + CASE WHEN {w} >= 30 THEN 1.0 WHEN {w} >= 20 THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches({s}, {q(L.ANALYTIC_MARKS)}) THEN 1.0 ELSE 0.0 END)::DOUBLE")
