"""Each operator against brute force, another library or SQL, and on awkward input."""

import base64
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bpe, op01_token_counts, op02_topk, op03_lm, op04_quality, op05_mixing, op06_langid, op07_warc, op08_rules, op09_simhash, op10_bpe, queries
from tallyforge.llm import textbatch as tb

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, FP string, host int, y double, `Label` string"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AWKWARD = [
    "", " ", "a", "It's  we'll\n\n fine 123abc …", "x'S 'll \t\r\n  y", "日本語 текст été ß İ", "a" * 3000, "ab " * 20000, "!!!" * 50, "  z", "thethethe the the", "<|endoftext|>", "\x00\x01", "👍🏽 ok",
]


@pytest.fixture(scope="module")
def coding():
    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", None)[i % 2], len(t), "x", 1, 0.5, "l") for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id here", "en", "s0", 3, None, None, None, None), (100, None, None, None, None, None, None, None, None)]
    rows += [(101, "same row here", "en", "s0", 13, "x", 1, 0.5, "l")] * 2 + [(102, "same row here", "en", "s0", 13, "x", 1, 0.5, "l"), (101, "other text of one id", "fr", "s1", 1, "x", 1, 0.5, "l")]
    rows += [(200 + i, " ".join(f"word{(i * 7 + j * j) % 50}" for j in range(60)) + ".\n" * (i % 3), "en", f"s{i % 4}", 9, "x", 1, 0.5, "l") for i in range(20)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 220)] + [(None, 1, None), (7, None, None), (7, 0, 0), (203, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def sql(query, sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(query).fetch_df()


def rows(frame):
    clean = lambda v: None if v is None or v is np.nan or v != v else (v.item() if isinstance(v, np.generic) else v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(sql(queries.ORACLES[name], sf))


FRAMES = {
    "counts": lambda d, m: op01_token_counts.token_counts(d),
    "lm": op03_lm.score,
    "quality": op04_quality.classify,
    "mixing": lambda d, m: op05_mixing.schedule(d),
    "langid": lambda d, m: op06_langid.identify(d),
    "rules": lambda d, m: op08_rules.judged(d),
    "simhash": lambda d, m: op09_simhash.groups(d),
    "bpe": lambda d, m: op10_bpe.encode(d),
}


@pytest.mark.parametrize("name", FRAMES)
def test_awkward_rows(docs, labels, name):
    got = FRAMES[name](docs, labels).collect()
    if name in ("counts", "quality", "langid", "rules", "bpe"):
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    elif name in ("lm", "simhash"):
        assert sorted(r["doc_id"] for r in got) == sorted({r["doc_id"] for r in docs.collect()} - {None})


@pytest.mark.parametrize("name", FRAMES)
def test_empty_tables(docs, labels, name):
    assert FRAMES[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["lm", "quality"])
def test_without_labels(docs, labels, name):
    assert FRAMES[name](docs, labels.limit(0)).count() > 0


def test_token_counts_equal_another_encoder(docs, spark, sf, coding):
    for frame in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter((r["doc_id"], None if r["text"] is None else len(coding.encode_ordinary(r["text"]))) for r in frame.collect())
        assert Counter((r["doc_id"], r["n_tokens"]) for r in op01_token_counts.token_counts(frame).collect()) == want


def test_bpe_equals_another_encoder_and_decodes(docs, spark, sf, coding):
    for frame in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter((r["doc_id"], None if r["text"] is None else tuple(coding.encode_ordinary(r["text"]))) for r in frame.collect())
        got = op10_bpe.encode(frame).collect()
        assert Counter((r["doc_id"], None if r["tokens"] is None else tuple(r["tokens"])) for r in got) == want
        assert all(r["round_trip"] for r in got if r["tokens"] is not None)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 7)) * rng.choice([0.1, 1, 5], (900, 1)), 2)
    x[10:20] = x[0]
    x[30] = 0
    data = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 7, 1.0), (2000, None, 1.0), (2001, [], 1.0), (2002, [None] * 7, 1.0), (2003, [math.nan] * 7, 1.0), (2004, [1.0, 2.0], 1.0), (0, x[0].tolist(), 1.0)]
    frame = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>, score double")
    got = defaultdict(list)
    for r in sorted(op02_topk.top_k(frame, 10, shard=100).collect()):
        got[r["vec_id"]].append((r["neighbor_id"], r["score"]))
    score = np.round(x @ x.T, 6) + 0.0
    for i in range(900):
        want = sorted((j for j in range(900) if j != i), key=lambda j: (-score[i, j], j))[:10]
        assert [j for j, _ in got[i]] == want
    assert set(got) == set(range(900))
    assert op02_topk.top_k(frame.limit(0)).count() == 0


def test_lm_scores_equal_brute_force(docs, labels):
    good = defaultdict(list)
    for r in labels.collect():
        if r["doc_id"] is not None:
            good[r["doc_id"]].append((r["quality"] or 0, r["toxic"] or 0))
    target = {k for k, v in good.items() if max(q for q, _ in v) == 1 and max(t for _, t in v) == 0}
    texts = [(r["doc_id"], regex.findall(r"[\p{L}\p{N}]+", (r["text"] or "").lower())) for r in docs.collect() if r["doc_id"] is not None]
    own = [(d, Counter(["", *words][:-1] if words else []), Counter(zip(["", *words], words))) for d, words in texts]
    v = len({w for _, words in texts for w in words})
    both = [[sum((x[k] for x in own if x[0] in only), Counter()) for k in (1, 2)] for only in (target, {d for d, _ in texts})]
    n, loss = Counter(), [Counter(), Counter()]
    for d, mine1, mine2 in own:
        n[d] += sum(mine2.values())
        for i, (c1, c2) in enumerate(both):
            mine = i == 1 or d in target
            loss[i][d] -= sum(k * math.log((c2[p, w] - k * mine + 0.1) / (c1[p] - mine1[p] * mine + 0.1 * v)) for (p, w), k in mine2.items())
    for r in op03_lm.score(docs, labels).collect():
        d = r["doc_id"]
        assert r["n_words"] == n[d]
        for i, name in enumerate(("target_loss", "background_loss")):
            assert r[name] is None if n[d] == 0 else abs(r[name] - loss[i][d] / n[d]) < 2e-6


def test_language_of_held_out_texts(spark, sf):
    every = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    filters = op06_langid.fit(every.where("doc_id % 2 = 0"))
    got = op06_langid.identify(every.where("doc_id % 2 = 1"), filters).join(every.select("doc_id", "lang"), "doc_id").where("n_grams > 20").collect()
    assert len(got) > 300 and np.mean([r["language"] == r["lang"] for r in got]) > 0.97


def test_language_filters_correct_for_false_positives():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 200_000, dtype=np.uint64) for _ in range(3)]
    filters = op06_langid.Filters(["a", "b", "c"], sets)
    n, rates = filters.rates(np.concatenate([sets[0][:5000], rng.integers(0, 2**63, 5000, dtype=np.uint64)]), np.repeat([0, 1], 5000), 2)
    assert n.tolist() == [5000, 5000] and rates[0, 0] == 1 and rates[0, 1:].max() < 0.03 and rates[1].max() < 0.03


def test_language_filters_hold_more_than_a_slice():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(130)]
    filters = op06_langid.Filters([f"l{i:03}" for i in range(130)], sets)
    n, rates = filters.rates(np.concatenate([sets[i] for i in (0, 63, 64, 129)]), np.repeat(np.arange(4), 500), 4)
    assert n.tolist() == [500] * 4 and rates.argmax(1).tolist() == [0, 63, 64, 129] and np.sort(rates, axis=1)[:, -2].max() < 0.03


def test_simhash_groups_equal_brute_force(spark, sf):
    every = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").unionByName(spark.createDataFrame([(5001, None, "en", "s", 0), (5002, "", "en", "s", 0), (5003, "", "en", "s", 0), (5004, "!?", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    fps = {r["doc_id"]: r["fp"] for r in op09_simhash.fingerprints(every).collect()}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if fps[a] is not None and fps[b] is not None and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= op09_simhash.RADIUS:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    sizes = Counter(find(d) for d in ids)
    got = {r["doc_id"]: (r["group_id"], r["group_size"], r["keep"]) for r in op09_simhash.groups(every).collect()}
    assert got == {d: (find(d), sizes[find(d)], find(d) == d) for d in ids}
    assert got[5001] == (5001, 1, True) and got[5003][0] == 5002


def test_multi_index_finds_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    values = set(base.tolist())
    for b in base:
        for k in range(1, 12):
            flips = rng.choice(64, k, replace=False)
            values.add(int(np.int64(np.uint64(b.view(np.uint64)) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= op09_simhash.RADIUS}
    got = [(r["a"], r["b"]) for r in op09_simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_keeps_texts_of_the_same_common_words_apart(spark):
    rng = np.random.default_rng(5)
    words = [f"common{i}" for i in range(200)]
    other = [words[i] for i in rng.permutation(200)][:-1] + ["rare"]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*words[:-1], "rare"]))], "doc_id bigint, text string")
    fps = {r["doc_id"]: r["fp"] for r in op09_simhash.fingerprints(frame).collect()}
    assert ((fps[1] ^ fps[2]) & (2**64 - 1)).bit_count() <= op09_simhash.RADIUS
    assert all(r["keep"] and r["group_size"] == 1 for r in op09_simhash.groups(frame.where("doc_id < 3")).collect())
    got = {r["doc_id"]: r["group_id"] for r in op09_simhash.groups(frame.where("doc_id <> 2")).collect()}
    assert got == {1: 1, 3: 1}


def test_simhash_finds_edited_copies(spark):
    rng = np.random.default_rng(6)
    texts = [[f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 200), 50_000)] for _ in range(200)]
    edited = [[f"new{int(rng.integers(10**6))}" if rng.random() < 0.05 else w for w in t] for t in texts]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, *edited])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["group_id"] for r in op09_simhash.groups(frame).collect()}
    assert np.mean([got[i + 200] == got[i] for i in range(200)]) > 0.85  # 5% of the words replaced
    assert all(got[i] == i for i in range(200))


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in op09_simhash.components(pairs).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_mixture_shares_follow_weights(spark, sf):
    every = spark.read.parquet(f"{sf}/documents.parquet")
    got = op05_mixing.schedule(every, {"src0": 3.0, "src1": 1.0}).select("slot", "source").distinct().groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) == {"src0", "src1"} and abs(n["src0"] / sum(n.values()) - 0.75) < 0.1
    assert op05_mixing.schedule(every, {}).count() == 0


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<title>T &amp; U</title><style>p{}</style><p>Hi<b>!</b><p>there"), (2, None, None), (None, "http://b", ""), (1, "http://a/x", "<p>Hi")], "page_id bigint, url string, html string")
    source = op07_warc.responses(pages.withColumn("record", F.lit(1)))
    got = op07_warc.derivatives(source).collect()
    assert len(got) == 8 and {r["refers_to"] for r in got} == {r["record_id"] for r in source.collect()}
    for r in got:
        head, _, body = r["record"].partition("\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Block-Digest"] == r["block_digest"]
        assert body.endswith("\r\n\r\n") and len(body[:-4].encode()) == int(headers["Content-Length"]) == r["content_length"]
        assert ("WARC-Target-URI" in headers) == (r["target_uri"] is not None)
    assert [r["record"].split("\r\n\r\n")[1] for r in got if r["record_type"] == "conversion" and r["page_id"] == 1][0].startswith(("T & U\nHi!\nthere", "Hi"))
    by = {r["record_id"]: r["linked_to"] for r in got}
    assert all(by[by[k]] == k for k in by)
    assert op07_warc.derivatives(op07_warc.responses(pages.limit(0))).count() == 0


def test_quality_on_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    marks = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    for name in ("op4_quality", "op8_rules"):
        got = queries.QUERIES[name](spark, big).join(marks, "doc_id").collect()
        assert np.mean([r["keep"] for r in got if r["truth"] == 1]) > 0.98
        assert np.mean([not r["keep"] for r in got if r["truth"] == 0]) > 0.9


def test_pretokens_tile_like_the_pattern():
    import pyarrow as pa

    texts = [*AWKWARD, "a'b c'D 'tis", "''s", "  'll", "1'st\n'x"]
    data, off = tb.flat(pa.array(texts))
    begins, n = tb.pretokens(data, off, tb.class_table())
    ends = np.cumsum(n)
    for i, t in enumerate(texts):
        want = [len(x.encode()) for x in regex.findall(PATTERN, t)]
        own = np.append(begins[ends[i] - n[i] : ends[i]], off[i + 1])
        assert np.diff(own).tolist() == want, t


def test_pipeline_stages_on_awkward_rows(spark, docs, sf):
    given = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, given.limit(0), sf).count() == 0
        given = spark.createDataFrame(out.collect(), out.schema)
    assert given.count() > 0


def test_pipeline_keeps_a_row_of_every_text(spark, sf):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (3, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3] + " more"), (4, None), (None, None)]
    given = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, given, sf).collect()]
    assert len(got) == 6 and {(1, texts[0]), (1, texts[1]), (3, texts[2]), (4, None), (None, None)} < set(got)
    assert sum(t in (texts[3], texts[3] + " more") for _, t in got) == 1


def test_pipeline_equals_its_parts(spark, sf, coding):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in op04_quality.classify(frame, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["keep"]}
    frame = frame.where(F.col("doc_id").isin(*good))
    good = {r["doc_id"] for r in op08_rules.judged(frame).collect() if r["keep"]}
    frame = frame.where(F.col("doc_id").isin(*good))
    fps = {r["doc_id"]: r["fp"] for r in op09_simhash.fingerprints(frame).collect()}
    left, seen = [], set()
    for d in sorted(fps):  # the smallest id of each component
        if d not in seen:
            left.append(d)
            todo = [d]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += [b for b in fps if b not in seen and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= op09_simhash.RADIUS]
    got = corpus_pipeline.run(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert {r["doc_id"] for r in got} == {d for d in left if re.search(r"[^ \t\n\r]", text[d])}
    assert all(list(r["tokens"]) == coding.encode_ordinary(text[r["doc_id"]]) for r in got)


def outcome(patterns, chosen):
    """Posterior quality of a vote pattern, given as the rules that vote bad."""
    prior, table = op08_rules.estimate(sorted(patterns.items()))
    votes = [-1 if n in chosen else 1 for n in op08_rules.NAMES]
    odds = math.log(prior / (1 - prior)) + sum(math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) for v, (a, b) in zip(votes, table))
    return 1 / (1 + math.exp(-odds))


@pytest.mark.parametrize("share", [0.001, 0.02, 0.2, 0.4])
def test_rules_outvote_one_that_misfires(share):
    rng = np.random.default_rng(4)
    patterns = Counter()
    for i in range(10_000):
        bad = ("marks", "mark_runs", "letters") if i % 10 == 0 else ("capitals", "shouting") if i % 10 == 1 else ("word_size",) if rng.random() < share else ()
        patterns[tuple(-1 if n in bad else 1 for n in op08_rules.NAMES)] += 1
    assert outcome(patterns, ("word_size",)) > 0.5 and outcome(patterns, ()) > 0.9
    assert outcome(patterns, ("marks", "mark_runs", "letters")) < 0.05 and outcome(patterns, ("capitals", "shouting")) < 0.1


def test_rules_are_not_a_filter_that_all_must_pass(spark, sf):
    every = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    long_words = " ".join("abcdefghijklmnopqrst"[i:] + "abcdefghijklmnopqrst"[:i] for i in range(20))  # one rule's vote is bad
    got = op08_rules.judged(every.unionByName(spark.createDataFrame([(10**6, long_words)], "doc_id bigint, text string"))).collect()
    one = next(r for r in got if r["doc_id"] == 10**6)
    assert one["n_bad"] == 1 and one["keep"] and any(not r["keep"] for r in got)


def test_long_pages_and_records_of_real_responses(spark):
    odd = {"comment": "<!-- x " * 150_000, "tags": "<" * 1_000_000, "hidden": "<script>a" * 100_000, "title": "<title" * 150_000, "link": "<a " * 300_000}
    pages = spark.createDataFrame([(i, "http://a", t) for i, t in enumerate(odd.values())], "page_id bigint, url string, html string")
    assert op07_warc.derivatives(op07_warc.responses(pages)).agg(F.count("*"), F.sum(F.length("record"))).first()[0] == 2 * len(odd)
    http = "HTTP/1.1 404 Not Found\r\nServer: böx\r\nContent-Type: text/html\r\nX-Two: a\r\nX-Two: b\r\n\r\n"
    payload = "<p>gone <!-- a <!-- b --> now</p>"
    block = http + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Block-Digest: sha1:AA\r\nContent-Length: {len(block.encode())}\r\n\r\n"
    rows = [(1, head + block + "\r\n\r\n"), (2, head.replace("response", "request") + block), (3, None), (4, "no record"), (5, "")]
    source = op07_warc.read_responses(spark.createDataFrame(rows, "page_id bigint, record string"))
    got = source.collect()
    assert len(got) == 1 and (got[0]["http"], got[0]["payload"], got[0]["record_id"], got[0]["block_digest"]) == (http, payload, "<urn:uuid:1>", "sha1:AA")
    made = {r["record_type"]: r for r in op07_warc.derivatives(source).collect()}
    assert "source-header: HTTP/1.1 404 Not Found\r\nsource-header: Server: böx" in made["metadata"]["record"] and "source-block-digest: sha1:AA" in made["metadata"]["record"]
    assert made["conversion"]["refers_to"] == "<urn:uuid:1>" and made["conversion"]["record"].split("\r\n\r\n")[1] == "gone now"


def test_long_words_equal_another_encoder(spark, coding):
    rng = np.random.default_rng(8)
    letters = lambda n, kinds: "".join(chr(97 + int(i)) for i in rng.integers(0, kinds, n))
    texts = [letters(n, k) for n in (127, 128, 129, 700) for k in (2, 26)] + [letters(20_000, 26), "abc" * 2000, "ab" * 3000, "日本語" * 300, "-=" * 400]
    got = op10_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(list(r["tokens"]) == coding.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"] for r in got)
    back = spark.createDataFrame([(list(r["tokens"]),) for r in got if len(r["tokens"]) < 500], "t array<int>").select(op10_bpe.decoded("t").alias("x")).collect()
    assert {r["x"] for r in back} <= set(texts)


def test_bpe_dictionary_of_small_blocks_equals_another_encoder(docs, coding, monkeypatch):
    monkeypatch.setattr(op10_bpe, "BLOCK", 300)
    monkeypatch.setattr(op10_bpe, "ENCODED", 200)
    assert len(op10_bpe.dictionary(docs.select("text"), bpe.default_vocabulary())[0]) > 40
    want = Counter((r["doc_id"], None if r["text"] is None else tuple(coding.encode_ordinary(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], None if r["tokens"] is None else tuple(r["tokens"])) for r in op10_bpe.encode(docs).collect()) == want


def test_bpe_look_up_holds_no_hash_table_of_the_dictionary():
    known = pa.array([b"known %d" % i for i in range(300_000)])
    words = pa.array([b"known %d" % i for i in range(299_999, 0, -600)] + [b"new %d" % i for i in range(500)])
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = op10_bpe.places(words, known).to_pylist()  # arrays mustn't outlive their pool
    finally:
        pa.set_memory_pool(usual)
    assert got == [*range(299_999, 0, -600)] + [None] * 500
    assert pool.max_memory() < 10 * len(known)  # with known as the table 70 bytes a word
    none = pa.array([], pa.binary())
    assert op10_bpe.places(none, known).to_pylist() == [] and op10_bpe.places(words, none).null_count == len(words)


def test_bpe_cuts_a_block_in_little_memory(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"wörd{i} it's" for i in rng.integers(0, 3000, 150)) for _ in range(1500)] + ["", None, "x" * 700_000, ""]
    table, classes = pa.table({"text": pa.array(texts)}), tb.class_table()
    tracemalloc.start()
    words, code, n_pre = op10_bpe.words_of(table, classes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(len(t.encode()) for t in texts if t)
    assert peak < 12 * size, peak / size
    monkeypatch.setattr(op10_bpe, "PART", 1 << 40)
    whole = op10_bpe.words_of(table, classes)
    assert words.equals(whole[0]) and (code == whole[1]).all() and (n_pre == whole[2]).all()
    assert b"".join(words.take(pa.array(code)).to_pylist()).decode() == "".join(t or "" for t in texts)


def test_topk_of_a_query_set_in_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(c, 0.05, (150, 8)) for c in rng.normal(size=(6, 8)) * 3]), 3)
    x[:300] = x[0]  # a third of all rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [math.inf] * 8)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(op02_topk.top_k(frame, 5, queries=frame.where("vec_id % 100 = 0"), shard=64, block=3).collect()):
        got[r["vec_id"]].append((r["neighbor_id"], r["rank"]))
    score = np.round(x @ x.T, 6) + 0.0
    assert set(got) == set(range(0, 900, 100))
    for i in got:
        want = sorted((j for j in range(900) if j != i), key=lambda j: (-score[i, j], j))[:5]
        assert got[i] == [(j, k + 1) for k, j in enumerate(want)]


def test_topk_prunes_clustered_data():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16)) * 4
    x = np.concatenate([rng.normal(c, 0.1, (512, 16)) for c in centres])
    best = op02_topk.Best(8, 10)
    order, tree = op02_topk.build(x)
    op02_topk.search(centres, np.full(8, -1), x[order], order, tree, best)
    assert best.products < 0.5 * 8 * len(x)


def test_languages_equal_exact_sets(spark, sf):
    every = spark.read.parquet(f"{sf}/documents.parquet")
    import pyarrow as pa

    rows = every.select("doc_id", "text", "lang").collect()
    classes, sets = tb.class_table(), {}
    for lang in sorted({r["lang"] for r in rows}):
        h, _ = op06_langid.grams(pa.array([r["text"] for r in rows if r["lang"] == lang]), classes)
        keys, n = np.unique(h, return_counts=True)
        sets[lang] = keys[n >= op06_langid.LEAST]
    filters = op06_langid.Filters(list(sets), list(sets.values()))
    got = {r["doc_id"]: r for r in op06_langid.identify(every, filters).collect()}
    for r in rows:
        h, _ = op06_langid.grams(pa.array([r["text"]]), classes)
        assert got[r["doc_id"]]["n_grams"] == len(h)
        if len(h) >= 20:
            shares = sorted((float(np.isin(h, s).mean()), lang) for lang, s in sets.items())
            assert abs(got[r["doc_id"]]["rate"] - shares[-1][0]) < 0.06
            if shares[-1][0] - shares[-2][0] > 0.12:
                assert got[r["doc_id"]]["language"] == shares[-1][1]


def test_simhash_equals_its_definition(spark):
    texts = ["one two two three", "Größe 12 größe", "a a a a b"]
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in op09_simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    mask = 2**64 - 1

    def word_hash(w):
        total = len(w)
        for i, b in enumerate(w):
            total += (b + 1) * pow(0x9E3779B97F4A7C15, i + 1, 2**64)
        h = total & mask
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    for i, t in enumerate(texts):
        sums = [0.0] * 64
        for w, n in Counter(regex.findall(r"[\p{L}\p{N}]+", t.lower())).items():
            h = word_hash(w.encode())
            for b in range(64):
                sums[b] += n**0.25 * (1 if h >> b & 1 else -1)
        assert got[i] == sum(1 << b for b in range(64) if sums[b] > 0)
