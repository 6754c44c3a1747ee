"""Training-data operators against brute force, the libraries and SQL on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from seriesloom.llm import (exact_dedup, passage_chains, pii_semicrf, pretokens, quality_cascade, queries, simhash_bk, source_mix,
                            token_automaton, token_counts, token_file, url_templates)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"
rng = random.Random(4)
VOICE = [f"w{i}" for i in range(400)]


def words(n):
    return " ".join(rng.choice(VOICE) for _ in range(n))


BODY = words(120)
ODD = ["", None, " \t\n", "a", "A a\x0bB", BODY, BODY, BODY + " tail", words(5000), "Σίσυφος İx ²½ <|endoftext|> 中文 \x1c's don't",
       "one\none\none", "mail a.b@c.de and +1 (988) 555-2485, 10.0.0.1, 4111 1111 1111 1111", "#$% " * 60, "!! " * 70]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, ties and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "r", "k") for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s3", 1, "r", "k"), (None, "lost", None, None, None, None, None), (90, words(80), "en", "s1", 1, "r", "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def config(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


BYTE, WORD = config("byte_bpe_50k.json"), config("word_bpe_49k.json")


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == len(rows) and exact_dedup.exact_dedup(empty).count() == 0
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    assert sum(r.kept for r in out) == len(groups)
    for r in out:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).digest() == bytes(r.digest))
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)


def test_digest_index_persists(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], "doc_id long, text string")
    path = str(tmp_path / "index")
    exact_dedup.exact_dedup(one, exact_dedup.DigestIndex(spark, path, 3)).collect()
    spark.sql(f"drop table {exact_dedup.DigestIndex(spark, path, 3).table}")
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, exact_dedup.DigestIndex(spark, path, 3)).collect()}
    assert found == {3: (2, False), 4: (5, False), 5: (5, True)}


def test_digest_index_survives_repeated_and_failed_batches(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "b"), (5, "c"), (6, "d")], "doc_id long, text string").repartition(2)
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)

    def result(df):
        return {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df, index).collect()}

    first = result(one)
    assert first == {1: (1, True), 2: (3, False), 3: (3, True)} == result(one.repartition(3))
    # a job that fails after a part of its digests was appended
    real = index._append
    monkeypatch.setattr(index, "_append", lambda rows: (real(rows.where("keep_id = 5")), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        result(two)
    monkeypatch.setattr(index, "_append", real)
    want = {4: (3, False), 5: (5, True), 6: (6, True)}
    assert result(two) == want and result(two) == want and result(one) == first
    small = index.compacted(str(tmp_path / "small"))
    assert sorted(map(tuple, small.read().collect())) == sorted(map(tuple, index.read().collect())) and small.read().count() == 4


def brute_print(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    s = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))


def test_simhash(spark, docs, empty):
    near = [BODY.replace(w, "z", 1) for w in BODY.split()[::17]]
    more = docs.unionByName(spark.createDataFrame([(200 + i, t, "en", "s", 1, "", "") for i, t in enumerate(near)], SCHEMA))
    rows = [(r.doc_id, brute_print(r.text or "")) for r in more.collect()]
    label = {i: i for i in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    want = sorted((str(i), p, min((rows[k][0] for k in label if label[k] == label[n] and rows[k][0] is not None), default=None))
                  for n, (i, p) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash_bk.near_dedup(more).collect())
    assert got == want and simhash_bk.near_dedup(empty).count() == 0
    assert simhash_bk.drop_near_copies(more).columns == docs.columns


def test_split_shards_lose_no_link(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 40, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (30, 40, 2)).astype(np.uint64)
    fp = np.unique(np.concatenate([base, (base ^ flips[..., 0] ^ flips[..., 1]).ravel()]))
    a, b = np.where(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    want = simhash_bk.merge_labels(np.arange(len(fp)), a, b)
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash_bk.linked(frame, tree_size=7, held_rows=50)
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    pairs = [(at[e.a], at[e.b]) for e in edges.collect()]
    got = simhash_bk.merge_labels(np.arange(len(fp)), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert (got == want).all()
    roots = {at[c.node]: c.root for c in simhash_bk.components(edges).collect()}
    for i, j in zip(a.tolist(), b.tolist()):
        assert roots.get(i) == roots.get(j)


def texts_of(docs):
    return {(r.doc_id, r.text): r.text or "" for r in docs.collect()}


def test_bpe_automaton(docs, empty):
    tok = Tokenizer.from_str(WORD)
    for r in token_automaton.encoded(docs.select("doc_id", "text", "row"), WORD).collect():
        options = [t for (i, _), t in texts_of(docs).items() if i == r.doc_id]
        want = [tok.encode(t, add_special_tokens=False).ids for t in options]
        assert r.ids in want and r.decoded == tok.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert token_automaton.encoded(empty, WORD).count() == 0


def test_automaton_and_pieces_on_random_text():
    tok, byte = Tokenizer.from_str(WORD), Tokenizer.from_str(BYTE)
    letters = "abcdefghijklmnopqrstuvwxyzeeeaaaott''ss  \t\n9ÉßΣσİ²\x1c 中̈ﬁ"
    ids = pretokens.piece_ids(BYTE)
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) + rng.choice(["", "aaaa", "zzzzzz", "lololo"])
        assert token_automaton.encode_text(WORD, t) == tok.encode(t, add_special_tokens=False).ids
        assert [i for p in pretokens.byte_pieces(byte, t) for i in ids(p)] == byte.encode(t, add_special_tokens=False).ids


def test_token_counts_and_file(docs, empty):
    tok = Tokenizer.from_str(BYTE)
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in plain.collect())
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(plain, BYTE).collect()}
    read = {r.doc_id: r for r in token_file.token_round_trip(plain, BYTE, with_ids=True).collect()}
    start = 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert counts[i] == (len(t.encode()), len(ids), len(ids) > 512)
        ids = ids + [0]
        assert (read[i].start, read[i].n_tokens, read[i].ids) == (start, len(ids), ids)
        assert read[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_counts.token_counts(empty, BYTE).count() == 0 and token_file.token_round_trip(empty, BYTE).count() == 0


def test_huffman_lengths():
    r = np.random.default_rng(3)
    for n, longest in ((1, 4), (2, 4), (9, 4), (16, 4), (300, 9), (1000, 20)):
        counts = np.sort(r.integers(1, 1 << 30, n) >> r.integers(0, 29, n)) + 1
        lengths = token_file.code_lengths(counts, longest)
        assert lengths.max() <= longest and (n < 2 or sum(2.0 ** -lengths) == 1)
        book = token_file.CodeBook.of(dict(enumerate(counts.tolist())), longest)
        ids = r.integers(0, n, 1500)
        bits, checkpoints = token_file.pack(ids, *book.encoder())
        assert (token_file.unpack(bits, checkpoints, len(ids), book.bits, *book.decoder()) == ids).all()
        rest = token_file.unpack(bits, checkpoints[3:], len(ids) - 768, book.bits, *book.decoder())
        assert (rest == ids[768:]).all()


def test_personal_data(docs, empty):
    model = pii_semicrf.train(docs)
    out = {r.doc_id: r for r in pii_semicrf.personal_data(docs, model).collect()}
    r = out[11]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base.startswith("email:5:13,phone:18:35,ip:37:45,card:47:66")
    assert not out[8].spans and not out[1].spans and pii_semicrf.personal_data(empty, model).count() == 0
    assert pii_semicrf.base_spans("300.1.1.1 4111111111111112 +12345") == []
    assert pii_semicrf.base_spans("a@b.c_x@y.z") == [(0, 5, "email"), (5, 11, "email")]


def test_crf_gradient_is_the_slope_of_the_likelihood():
    lattice, gold = pii_semicrf._example("x +1 (988) 555-2485 9", [(2, 19, "phone")])
    r = np.random.default_rng(1)
    model = pii_semicrf.SemiCRF(r.normal(size=(4, pii_semicrf.FEATURES)) * .2, r.normal(size=(5, 5)) * .2)
    step = pii_semicrf.SemiCRF.gradient(model, lattice, gold)
    zero = pii_semicrf.SemiCRF.gradient(model, lattice, [])
    assert np.isfinite(step[0]).all() and np.allclose((step[0] - zero[0])[3], lattice.features[lattice.rows[gold[0][:2]]])
    assert np.allclose(step[1].sum() - zero[1].sum(), 1 - (gold[0][1] - gold[0][0]))


def brute_quality(text):
    w = text.encode().split()
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, empty):
    some = docs.where("length(coalesce(text, '')) < 3000")
    want = sorted(map(str, (brute_quality(r.text or "") for r in some.collect())))
    out = quality_cascade.quality_report(some).collect()
    assert sorted(str((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out) == want
    kept = quality_cascade.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 90}
    assert quality_cascade.quality_report(empty).count() == 0
    rules = quality_cascade.ordered_rules(docs)
    assert set(rules) == set(quality_cascade.RULES)


def test_mix(docs, empty):
    out = source_mix.mix_report(docs).collect()
    again = source_mix.mix_report(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == docs.count()
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in out)
    assert source_mix.mix_report(empty).count() == 0
    mixed = source_mix.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 1.0), ("c", 1, 1.0), (None, 500, 1.0)], "source string, source_size long, mean_quality double")
    found = {r.source: r.target for r in source_mix.targets(sizes).collect()}
    want, weight, size = {}, {"a": 1, "b": 2, "c": 3, None: 1}, {"a": 10, "b": 1000, "c": 1, None: 500}
    left, open_ = 1511.0, set(weight)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    assert found == pytest.approx(want)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.org/fr/1", "http://x.example.com/de/7?q", "http://a.net", "http://a.net/x", "http://b.example.net/en/2#t"]
    urls += [f"http://h.example.com/de/{i}" for i in range(30)] + ["http://h.example.com/es/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.net/x", None)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.url_verdicts(pages).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == ("a.org", "/fr/1", "org/fr/", "allow") and out[4][2:] == ("example.com/de/", "block")
    assert out[5] == ("a.net", "", None, "allow") and out[6][2:] == ("net/", "block") and out[7][2:] == ("example.net/en/", "allow")
    assert url_templates.url_verdicts(pages.limit(0)).count() == 0


def test_url_shapes_agree_with_sql(spark, tmp_path):
    """Hexadecimal segments, digits, long paths and mixed branches, judged by the query's SQL as by the operator."""
    duckdb = pytest.importorskip("duckdb")
    con, urls = duckdb.connect(), []
    for i in range(400):
        host = rng.choice(["example.com", "example.net", "a.org", "b.info"])
        parts = [rng.choice(["de", "en", "fr", "x"]), rng.choice([f"{rng.getrandbits(80):020x}", str(i), "shop", "0123-4567-89ab-cdef"]),
                 *[rng.choice(["p", "q1", "deadbeefdeadbeef0"]) for _ in range(rng.randint(0, 3))]]
        urls.append((i, f"https://{host}/" + "/".join(parts) + rng.choice(["", "/", "?a=/b", "#c"])))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", urls)
    got = url_templates.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(queries.URL_SQL).fetchall()))


def test_parts_of_texts_are_encoded_once():
    """White space of all kinds beside a space, added strings and letters of all kinds, against the library."""
    bits = [" ", " ", "  ", "\n", " \n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "a", "foo", "'s", "'", "12", "²", "中文", "Σ", "é", "<|endoftext|>", "<|end", "!", "\u0301", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", " a", "a ", "<|endoftext|>"]
    ids, counts = token_file.encoded(pa.array(texts), BYTE, "<u2", 0)
    library = pretokens.library_tokenizer(BYTE)
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert list(token_file._spans(np.array([3, token_file.SPAN, 5, 5]))) == [(0, 1), (1, 2), (2, 4)] and not list(token_file._spans(np.array([])))


def test_cache_keeps_the_keys_in_use():
    made = []
    cache = pretokens.Cache(lambda key: made.append(key) or key, 100)
    for k in range(1000):
        assert cache[k] == k and cache["often"] == "often" and len(cache) + len(cache.older) <= 100
    assert made.count("often") == 1


def test_zones_and_texts_sent_for_personal_data(spark):
    """Zones are the runs of marked words, as found word by word; texts without a mark stay behind, their rows do not."""
    r = random.Random(3)
    texts = ["".join(r.choice("ab0@ \n \u00a0.") for _ in range(r.randrange(16))) for _ in range(3000)]
    for t in texts:
        want: list = []
        for m in re.finditer(r"\S+", t):
            if re.search("[0-9@]", m.group()):
                joins = want and m.start() == want[-1][1] + 1 and t[want[-1][1]] == " "
                want[-1:] = [(want[-1][0], m.end())] if joins else [*want[-1:], m.span()]
        assert list(pii_semicrf.zones(t)) == want
    rows = [(1, "no mark here"), (2, None), (3, "mail a@b.cd now"), (4, "")]
    out = pii_semicrf.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), pii_semicrf.SemiCRF(), margin=1e9)
    assert {x.doc_id: x.base for x in out.collect()} == {1: "", 2: "", 3: "email:5:11", 4: ""}
    assert "RLIKE" in out._jdf.queryExecution().optimizedPlan().toString()


def test_passages(spark, docs, empty):
    passage = words(60).split()
    rows = [(i, words(90) + " " + " ".join(passage) + " " + words(40)) for i in range(12)]
    fuzzy = passage[:20] + ["new"] + passage[20:41] + ["other"] + passage[42:]
    rows += [(50, words(33) + " " + " ".join(fuzzy)), (60, words(300)), (61, None), (62, "")]
    out = passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in out} == {*range(12), 50}
    assert all((r.start_word, r.end_word) == (90, 150) for r in out if r.doc_id < 12 and r.partner_id < 12)
    assert all(r.start_word == 33 and r.end_word == 94 for r in out if r.doc_id == 50)
    assert passage_chains.repeated_passages(empty).count() == 0
    assert {r.doc_id for r in passage_chains.repeated_passages(docs).collect()} == {5, 6, 7}


def test_fenwick_chains_are_optimal():
    for _ in range(200):
        n = rng.randint(1, 8)
        at, to = sorted(rng.randint(0, 60) for _ in range(n)), [rng.randint(0, 60) for _ in range(n)]
        best = [0.0] * n
        for i in range(n):
            best[i] = passage_chains.KMER + max([0.0, *(best[j] - passage_chains.GAP_COST * (at[i] - at[j] + to[i] - to[j])
                                                        for j in range(i) if at[j] < at[i] and to[j] < to[i])])
        i = max(range(n), key=lambda k: best[k])
        found = passage_chains.chains(np.array(at), np.array(to))
        assert (at[i], to[i]) in {x[2:] for x in found}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, FOLDER)
    at = [list(rel.columns).index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in rel.fetchall())))


def test_pipeline(spark):
    """Each stage's rows against brute force over its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, FOLDER).cache()
    exact = stages["exact dedup"](spark, good, FOLDER).cache()
    last = {}
    for r in good.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    near = stages["near dedup"](spark, exact, FOLDER).cache()
    prints = {r.doc_id: brute_print(r.text) for r in exact.collect()}
    kept = {r.doc_id for r in near.collect()}
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 4 for j in prints if j < i) for i in set(prints) - kept)
    assert not any((prints[i] ^ prints[j]).bit_count() <= 4 for i in kept for j in kept if i < j)
    assert near.columns == exact.columns == good.columns == docs.columns
    duckdb = pytest.importorskip("duckdb")
    con, tok = duckdb.connect(), Tokenizer.from_str(WORD)
    left = [(r.doc_id, r.text, r.source) for r in near.collect()]
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", left)
    copies = {i: taken // size for i, size, taken in con.sql(f"select doc_id, size, taken from ({queries.MIX_SQL}) where size > 0").fetchall()}
    want = []
    for i, text, _ in left:
        ids = tok.encode(text, add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] * copies.get(i, 0)
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run.collect()) == sorted(want)


def test_banded_alignment_does_not_depend_on_the_batch():
    """Pairs aligned together and alone agree, and the stretch found holds the planted passage with its edits."""
    random_ = np.random.default_rng(8)
    pairs, planted = [], []
    for _ in range(40):
        size, lead = int(random_.integers(80, 400)), int(random_.integers(0, 20))
        x = random_.integers(0, 60_000, size).astype("<u2")
        y = x.tolist()
        for place in random_.choice(size - 10, size // 12, replace=False):
            kind = int(random_.integers(3))
            y[place:place + (kind > 0)] = [7] * (kind < 2)
        y = np.concatenate([random_.integers(0, 60_000, lead), y, random_.integers(0, 60_000, 15)]).astype("<u2")
        pairs.append((x, y, lead, lead))
        planted.append((size, lead))
    together = passage_chains.align(pairs)
    assert together == [passage_chains.align([p])[0] for p in pairs]
    for (a, b, c, d, identity), (size, lead) in zip(together, planted):
        assert b - a >= 0.8 * size and identity >= 0.8 and c >= lead - 2 and 0 <= a < b <= size
    assert passage_chains.align([]) == []


def test_every_passage_of_a_pair(spark):
    """Two and three passages with unshared words between them, and a rewritten paragraph, against the planted places."""
    number = iter(range(10 ** 6))

    def own(n):
        return [f"u{next(number)}" for _ in range(n)]

    want, rows = {}, []
    for case, (sizes, gap, other_gap) in enumerate([((150, 60), 100, 100), ((150, 140), 100, 100), ((60, 150, 80), 90, 90),
                                                    ((150, 60), 100, 400), ((400, 70, 300), 250, 245), ((60, 55), 1500, 20)]):
        one, two, places = own(12), own(31), []
        for size in sizes:
            passage = own(size)
            places.append((len(one), len(one) + size, len(two), len(two) + size))
            one += passage + own(gap)
            two += passage + own(other_gap)
        rows += [(2 * case, " ".join(one)), (2 * case + 1, " ".join(two))]
        want[2 * case], want[2 * case + 1] = places, [(c, d, a, b) for a, b, c, d in places]
    out = passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {i: sorted((r.start_word, r.end_word, r.partner_start, r.partner_end) for r in out if r.doc_id == i) for i in want}
    assert got == want


def test_stretches_leave_none_beside_them():
    """Brute force over all stretches of a path that begin and end in an equal pair."""
    r = np.random.default_rng(5)
    for _ in range(60):
        good = np.concatenate([r.random(int(r.integers(5, 90))) < r.choice([0.1, 0.75, 0.82, 0.95]) for _ in range(5)])
        found = passage_chains._stretches(good)
        free = np.ones(len(good), bool)
        for a, b in found:
            assert b - a >= 50 and good[a:b].mean() >= 0.8 and good[a] and good[b - 1] and free[a:b].all()
            free[a:b] = False
        total, used = np.concatenate([[0], np.cumsum(good)]), np.concatenate([[0], np.cumsum(~free)])
        assert not any(good[a] and good[b - 1] and used[a] == used[b] and 5 * (total[b] - total[a]) >= 4 * (b - a)
                       for a in range(len(good)) for b in range(a + 50, len(good) + 1))


def test_passages_are_covered_whoever_else_holds_their_seeds(spark):
    """Mosaics of shared parts, versions of one text and second occurrences, against all pairs of documents."""
    r = random.Random(12)
    number = iter(range(10 ** 6))

    def own(n):
        return [f"m{next(number)}" for _ in range(n)]

    pool = [own(30) for _ in range(12)]
    texts = [sum((own(r.randint(5, 25)) + r.choice(pool) + r.choice(pool) for _ in range(4)), []) for _ in range(60)]
    shared = own(60)
    outsider = own(9) + shared[:30] + own(9)
    texts = [outsider, *texts, own(8) + shared + own(5), own(3) + shared + own(70), own(9) + shared[:30] + own(9)]
    repeated = own(55)
    texts += [own(5) + repeated + own(40) + repeated + own(7), own(31) + repeated + own(6)]
    versions = [own(200)]
    for _ in range(40):
        versions.append([next(iter(own(1))) if r.random() < 0.05 else w for w in versions[-1]])
    order = list(range(41))
    r.shuffle(order)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + v, " ".join(versions[v])) for v in order]
    out = passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    holders = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            holders.setdefault(tuple(t[k:k + 50]), set()).add(i)
    for i, t in enumerate(texts):
        found = {p for x in out if x.doc_id == i for p in range(x.start_word, x.end_word)}
        want = {p for k in range(len(t) - 49) if len(holders[tuple(t[k:k + 50])]) > 1 for p in range(k, k + 50)}
        assert want <= found
    for v in range(41):
        near = max(sum(a == b for a, b in zip(versions[v], versions[u])) for u in range(41) if u != v) / 200
        best = max((x.end_word - x.start_word) * x.identity for x in out if x.doc_id == 1000 + v) / 200
        assert best >= near - 0.06


def test_every_pair_of_many_holders_is_linked(spark):
    """Texts that hold the same common lines; only pairs of them go on alike, one word edited beside each line, and a seed
    of many places in one text. Every pair that goes on alike has a row, the others have none."""
    r = random.Random(31)
    number = iter(range(10 ** 6))

    def own(n):
        return [f"h{next(number)}" for _ in range(n)]

    lines = [own(12) for _ in range(5)]
    rows, order = [], list(range(60))
    for pair in range(60):
        parts = [own(2) for _ in lines]
        pool = [sum((line + part for line, part in zip(r.sample(lines, 5), parts)), [])]
        pool.append([w if w not in [part[0] for part in parts] else own(1)[0] for w in pool[0]])
        rows += [(2 * pair + k, " ".join(own(70) + pool[k] + own(70))) for k in (0, 1)]
    r.shuffle(rows)
    common = lines[0]
    rows += [(1000 + k, " ".join(sum((common + own(30) for _ in range(12)), []))) for k in range(3)]
    out = passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {(x.doc_id, x.partner_id) for x in out}
    assert {(2 * p + k, 2 * p + 1 - k) for p in order for k in (0, 1)} <= found
    texts = {i: t.split() for i, t in rows}
    for x in out:
        assert x.end_word - x.start_word >= 50 and x.identity >= 0.8
        assert len(set(texts[x.doc_id][x.start_word:x.end_word]) & set(texts[x.partner_id][x.partner_start:x.partner_end])) >= 40
    assert not any(max(pair) >= 1000 for pair in found)


def test_stored_tables_leave_no_shuffle_and_hold_no_seeds(spark):
    """Seeds are formed again from the stored words, and what a stored table shuffled is gone when it is written."""
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}

    docs = spark.createDataFrame([(i, words(60 + i)) for i in range(8)], "doc_id long, text string")
    before = shuffled()
    texts = passage_chains.stored(passage_chains.coded_texts(docs, "doc_id", "text").repartition(3, "doc_id"), "coded")
    assert not shuffled() - before and texts.columns == ["doc", "doc_id", "words"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    found = passage_chains.seed_table(texts, "doc_id", 1000).collect()
    assert {r.place // 1000 for r in found} == set(range(8)) and all(r.place % 1000 <= 60 + 8 - passage_chains.KMER for r in found)


def test_classes_of_a_seed_in_parts():
    """A seed whose rows come out in parts has the classes, and firsts in one count, that it has as a whole."""
    r = np.random.default_rng(5)
    rows = sorted({(int(k), int(a), int(d) * 1000 + int(p)) for k, a, d, p in zip(r.integers(0, 3, 900), r.integers(0, 12, 900), r.integers(0, 80, 900), r.integers(0, 1000, 900))})
    table = pa.table({n: [row[k] for row in rows] for k, n in enumerate(("key", "around", "place"))})

    def run(held):
        out = [row for b in passage_chains._classes(iter(table.to_batches(37)), 1000, held_rows=held) for row in b.to_pylist()]
        return out, {row["place"] for row in out if row["key"] is not None}, {(row["place"], row["other"]) for row in out if row["key"] is None}

    (whole, firsts, matches), (parts, firsts_in_parts, matches_in_parts) = run(1 << 17), run(50)
    assert firsts <= firsts_in_parts and matches == matches_in_parts
    for out in (whole, parts):
        for key in range(3):
            ranks = sorted(row["rank"] for row in out if row["key"] == key)
            assert ranks == list(range(len(ranks)))


def test_bound_of_compared_places_keeps_every_passage():
    """Passages around a seed with edits at random places: kept by the bound, while other rows of the seed are left out."""
    r, kept = np.random.default_rng(7), 0
    side, seed = passage_chains.SIDE, passage_chains.KMER
    for _ in range(40):
        x = r.integers(0, 60000, (30, 2 * side + seed)).astype(np.int32)
        y = r.integers(0, 60000, (30, 2 * side + seed)).astype(np.int32)
        x[:, side:side + seed] = y[:, side:side + seed] = x[0, side:side + seed]
        low = side - int(r.integers(0, 46))
        y[3, low:low + 50] = x[8, low:low + 50]
        free = [k for k in range(low, low + 50) if not side <= k < side + seed]
        y[3, r.choice(free, 10, replace=False)] = 60001
        p, q, _ = passage_chains._able(x, y)
        kept += (3, 8) in set(zip(p.tolist(), q.tolist()))
        assert len(p) < 20
    assert kept == 40


def test_recall_of_edited_passages():
    """Substitutions at random places in 50 words, every match of equal seeds given."""
    r, hits = np.random.default_rng(3), []
    for _ in range(100):
        one, two, p = (r.integers(1, 1 << 63, n, dtype=np.uint64) for n in (40, 55, 50))
        q = p.copy()
        q[r.choice(48, 7, replace=False) + 1] = r.integers(1, 1 << 63, 7, dtype=np.uint64)
        x, y = np.concatenate([one, p, two]), np.concatenate([two[::-1], q, one[::-1]])
        (a, ka, _), (b, kb, _) = passage_chains.seeds(x), passage_chains.seeds(y)
        at = np.array([(i, j) for i, k in zip(a, ka) for j in b[kb == k]], np.int64).reshape(-1, 2).T
        codes = [(t >> np.uint64(48)).astype("<u2") for t in (x, y)]
        found = [s for i, j, k, m in passage_chains.pieces(*at) for s in passage_chains.align_all([(*codes, j - i, m - k)])[0]] if at.size else []
        hits.append(any(min(s[1], 90) - max(s[0], 40) >= 40 for s in found))
    assert np.mean(hits) >= 0.95


def test_radius_beyond_the_blocks_is_an_error(spark):
    frame = spark.createDataFrame([(1,), (2,)], "fp long")
    with pytest.raises(ValueError):
        simhash_bk.linked(frame, radius=5)


def test_chains_of_a_pair_are_joined():
    """Overlapping chains on near diagonals become one; others, and those of other pairs, stay as they are."""
    rows = [(1, 2, 0, 10, 40, 50), (1, 2, 30, 45, 90, 104), (1, 2, 60, 400, 80, 420), (1, 2, 900, 910, 950, 960), (1, 3, 0, 10, 40, 50)]
    names = ["doc", "partner", "a", "b", "c", "d"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=names) for part in (rows[:2], rows[2:])]
    out = sorted(tuple(r.values()) for b in passage_chains._merged(iter(batches), 64) for r in b.to_pylist())
    assert out == [(1, 2, 0, 10, 90, 104), (1, 2, 60, 400, 80, 420), (1, 2, 900, 910, 950, 960), (1, 3, 0, 10, 40, 50)]
    assert sum(b.num_rows for b in passage_chains._merged(iter([]), 64)) == 0


def test_shared_words_within_the_band():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (rng.integers(0, 12, int(rng.integers(0, 40))).astype("<u2") for _ in range(2))
        low, width = int(rng.integers(-50, 50)), int(rng.integers(1, 30))
        want = [any(0 <= j < len(y) and y[j] == w for j in range(i + low, i + low + width)) for i, w in enumerate(x)]
        assert passage_chains._in_band(x, y, low, width).tolist() == want


def test_texts_of_unlike_length_need_no_wider_band():
    """A passage in a short and in a very long text, at every place, with inserted words: found whatever stands around it."""
    rng = np.random.default_rng(6)
    for front, back in ((0, 3000), (3000, 0), (2500, 2500), (0, 0)):
        passage = rng.integers(0, 60000, 120)
        edited = np.concatenate([passage[:50], [60001, 60002, 60003], passage[50:90], [60004], passage[90:]])
        x = np.concatenate([rng.integers(0, 60000, front), passage, rng.integers(0, 60000, back)]).astype("<u2")
        y = np.concatenate([rng.integers(0, 60000, 7), edited]).astype("<u2")
        shift = 7 - front
        [(a, b, c, d, identity)] = passage_chains.align_all([(x, y, shift, shift + 4)])[0]
        assert (a, b, c, d) == (front, front + 120, 7, 131) and identity > 0.95
        [(c, d, a, b, _)] = passage_chains.align_all([(y, x, -shift, -shift - 4)])[0]
        assert (a, b, c, d) == (front, front + 120, 7, 131)
