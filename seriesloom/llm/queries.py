"""One query for each operator over its whole table, with the SQL that checks it where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    exact_dedup,
    hard_negatives,
    line_runs,
    passage_chains,
    pii_semicrf,
    ptolemy_kmeans,
    quality_cascade,
    simhash_bk,
    source_mix,
    token_automaton,
    token_counts,
    token_file,
    url_templates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


EXACT_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


@query("op2_exact_dedup", EXACT_SQL)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUALITY_SQL = r"""
with body as (select doc_id, coalesce(text, '') as text from documents),
words as (select doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word,
                 generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as place from body),
windows as (select doc_id, place, word as a, lead(word) over w as b, lead(word, 2) over w as c
            from words window w as (partition by doc_id order by place)),
repeated as (select doc_id, place, count(*) over (partition by doc_id, a, b, c) as times from windows where c is not null),
starts as (select doc_id, place from repeated where times > 1),
covered as (select doc_id, count(distinct place + step) as n from starts, (values (0), (1), (2)) as s(step) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from body),
dups as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines
         where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n_letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_capitals,
         length(text) - length(replace(text, '!', '')) as n_shouts from body),
joined as (
  select c.*, coalesce(d.n_lines, 0) as n_lines, coalesce(d.n_dup_lines, 0) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words
  from counts c left join dups d using (doc_id) left join covered v using (doc_id)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from joined)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or word_chars > 12 * n_words or word_chars < 2 * n_words
            or 100 * n_dup_lines > 40 * n_lines or 2 * n_capitals > n_letters or 2 * n_shouts > n_words) as kept
from base
"""


@query("op8_quality_rules", QUALITY_SQL)
def quality(spark: SparkSession, folder: str) -> DataFrame:
    report = quality_cascade.quality_report(documents(spark, folder))
    names = {c: F.col(c) for c in report.columns}
    failed = quality_cascade.first_failed(list(quality_cascade.BASE_RULES), names).isNotNull()
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


MIX_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         0.5::double + length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D0-9!"#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~-]', '', 'g'))::double
           / greatest(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')), 1)::double as quality
  from documents),
keyed as (
  select *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / quality as key
  from docs),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3.0::double * source_size as cap from sizes),
levels as (
  select *, cap / weight as ratio,
         (sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
  from ranked window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, case when level > ratio then cap else (max(case when level <= ratio then level end) over ()) * weight end as target
  from levels),
plans as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets),
groups as (select source, key, doc_id, size, sum(size) as together from keyed group by all),
runs as (
  select *, coalesce(sum(together) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from groups)
select k.doc_id, k.size::bigint as size, p.source_size, p.target,
       (p.epochs * k.size + case when 2 * r.before + r.together <= 2 * (p.target - p.epochs * p.source_size) then k.size else 0 end)::bigint as taken
from keyed k join plans p on k.source is not distinct from p.source
join runs r on r.source is not distinct from k.source and r.doc_id is not distinct from k.doc_id and r.key = k.key and r.size = k.size
"""


@query("op9_source_mix", MIX_SQL)
def mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix_report(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


URL_SQL = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
split as (
  select page_id, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from parts),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from split),
marked as (
  select *, (rule in ('net/', 'example.com/de/'))::int as b, (rule in ('example.net/en/', 'org/fr/'))::int as a,
         regexp_replace(path, '^/', '') as plain from ruled),
parted as (
  select *, list_transform(string_split(plain, '/'), lambda s: case when regexp_matches(s, '^[0-9a-fA-F-]{16,}$') then '{h}'
                           else regexp_replace(s, '[0-9]+', '{n}', 'g') end) as segments from marked),
shaped as (select *, list_concat(segments[1:3], case when len(segments) > 3 then ['**'] else [] end) as shape from parted),
t0 as (select *, coalesce(b, 0) as bl, coalesce(a, 0) as al, '' as t0 from shaped),
"""


def _url_level(k: int) -> str:
    """One level of the template tree: `t{k-1}` to `t{k}`, named by the same tests as the operator's."""
    last = f"t{k - 1}"

    def odd(part: str) -> str:
        n, rest = f"n{k}", f"(tn{k} - n{k})"
        share = f"(t{part}{k}::double / tn{k})"
        error = f"sqrt({share} * (1 - {share}) * (1::double / {n} + 1::double / greatest({rest}, 1)))"
        gap = f"abs({part}{k}::double / {n} - (t{part}{k} - {part}{k})::double / greatest({rest}, 1))"
        return f"({rest} > 0 and {error} > 0 and {gap} > 2 * {error})"

    return f"""
s{k} as (select *, shape[{k}] as s{k} from {last}),
b{k} as (select host, {last}, s{k}, count(*) as n{k}, sum(bl) as b{k}, sum(al) as a{k} from s{k} where s{k} is not null group by all),
n{k} as (select *, sum(n{k}) over w as tn{k}, sum(b{k}) over w as tb{k}, sum(a{k}) over w as ta{k}, count(*) over w as c{k}
         from b{k} window w as (partition by host, {last})),
m{k} as (select host, {last}, s{k}, case when c{k} = 1 then s{k} when (c{k} > 20 and 3 * c{k} > tn{k}) or not ({odd('b')} or {odd('a')}) then '*' else s{k} end as name{k} from n{k}),
t{k} as (select s{k}.*, case when name{k} is null then s{k}.{last} else s{k}.{last} || '/' || name{k} end as t{k}
         from s{k} left join m{k} on s{k}.host = m{k}.host and s{k}.{last} = m{k}.{last} and s{k}.s{k} = m{k}.s{k})"""


URL_SQL += ",".join(_url_level(k) for k in range(1, 5)) + """
select page_id, host, path, rule,
       case when b = 1 then 'block' when a = 1 then 'allow'
            when (sum(bl) over t + 2.0::double) / (sum(bl) over t + sum(al) over t + 4.0::double) >= 0.8::double then 'block' else 'allow' end as verdict
from t4 window t as (partition by host, t4)
"""


@query("op10_url_filter", URL_SQL)
def urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.url_verdicts(spark.read.parquet(f"{folder}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_simhash_near_dedup")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_bk.near_dedup(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op4_bpe_automaton")
def bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_automaton.encoded(documents(spark, folder), vocabulary("word_bpe_49k.json"), with_ids=False)


@query("op5_token_counts")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@query("op3_token_file")
def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_file.token_round_trip(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@query("op6_personal_data")
def private(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_semicrf.personal_data(documents(spark, folder))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op1_repeated_passages")
def passages(spark: SparkSession, folder: str) -> DataFrame:
    return passage_chains.repeated_passages(documents(spark, folder))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
   and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def negatives(spark: SparkSession, folder: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(embeddings(spark, folder).withColumn("label", turned))


LINES_SQL = r"""
with body as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lined as (select doc_id, generate_subscripts(lines, 1) as place, unnest(lines) as line from body),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lined),
frequent as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where f.key is null), '')) as kept_sha256
from keyed left join frequent f using (key) group by doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def frequent_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_runs.line_dedup(documents(spark, folder)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


CENTROID_SQL = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as cluster, e from v
  qualify row_number() over (order by sha256('3:' || vec_id)) <= 8),
"""


def _assigned_sql(centres: str) -> str:
    return f"""select vec_id, v.e, cluster, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::bigint as distance
  from v cross join {centres} c
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1"""


for _k in range(1, 11):
    CENTROID_SQL += f"""a{_k} as materialized ({_assigned_sql(f"c{_k - 1}")}),
s{_k} as (select cluster, i, sum(e[i])::bigint as s, count(*) as n from a{_k}, range(1, 65) r(i) group by cluster, i),
c{_k} as materialized (
  select cluster, coalesce(m.e, c.e) as e from c{_k - 1} c
  left join (select cluster, list((s - ((s % n) + n) % n) // n order by i) as e from s{_k} group by cluster) m using (cluster)),
"""
CENTROID_SQL += f"""placed as ({_assigned_sql("c10")})
select vec_id, p.cluster, distance, sum(distance) over (partition by p.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c.e, ',')) as centroid_sha256
from placed p join c10 c on c.cluster = p.cluster
"""


@query("op13_centroids", CENTROID_SQL)
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    return ptolemy_kmeans.cluster(embeddings(spark, folder))
