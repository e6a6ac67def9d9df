"""Operators of chartweave.llm against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartweave.llm import ann, bpe, chunk_dedup, entries, langid, mixing, neardup, oracle, quality, search, sharding, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Score double, tokens string"
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeats, clashing columns."""
    long, base = prose(30000), prose(120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", " \n ", "<|endoftext|> Hello, it's 'Re", "été naïve 中文字符 🙂", long, base, base, near, "x", prose(60) + " " + base, "The The The The The"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", None, 0.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, base, None, None, None, 0.1, "x")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_library(spark, odd, empty, docs):
    import tiktoken

    path = entries.tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (odd, empty, docs):
        encoded = bpe.encode_documents(table, path, public_tokenizers.PATTERN)
        for r in bpe.decode_documents(encoded, path).collect():
            assert r.tokens == library.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    got = {r.doc_id: r for r in entries.op1_byte_bpe(spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[r.doc_id].n_tokens == len(ids)


def test_token_counts_equal_library(odd, empty, docs):
    from tokenizers import Tokenizer

    path = entries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for table in (odd, empty, docs):
        for r in token_counts.count_tokens(table, path).collect():
            assert r.n_tokens == count(r.text or "") and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048)
    counter = token_counts.load(path)
    text = "it's 'reading 12 naïve été!!"
    table = counter.prefix_counts(text)
    assert list(table) == [count(text[:i]) for i in range(len(text) + 1)]
    assert count(text[: token_counts.truncation_point(table, 4)]) <= 4


def test_search_answers_by_floors(docs, odd, monkeypatch):
    """Texts are taken apart once for all blocks of queries; behind the first documents a shard answers only what reaches the floor."""
    written, kept = [], search.stash
    monkeypatch.setattr(search, "stash", lambda df, name: written.append((name, kept(df, name))) or written[-1][1])
    got, rows = {}, {}
    for block in (8192, 3):
        written.clear()
        got[block] = sorted(map(tuple, search.top_k(docs, F.col("doc_id") % 20 == 0, k=3, shard_rows=10, query_block=block).collect()))
        rows[block] = sum(t.count() for name, t in written if name == "search-found")
        assert sum(name == "search-docs" for name, _ in written) == 2
    assert got[3] == got[8192] and len({q for q, *_ in got[3]}) >= 8
    assert rows[8192] < len({q for q, *_ in got[3]}) * 3 * (docs.count() // 10) / 3 and rows[3] == rows[8192]


def test_search_of_repeated_ids(spark):
    """Rows that repeat an id take no place of others, even where one shard has more of them than are asked for."""
    table = spark.createDataFrame([(1, "alpha beta")] * 30 + [(k, "alpha " + "gamma " * k) for k in range(2, 9)], "doc_id long, text string").coalesce(1)
    got = [(r.rank, r.doc_id) for r in search.top_k(table, F.col("doc_id") == 1, k=4).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_search_equals_brute_force(docs, odd, empty):
    for table, is_query in ((docs, F.col("doc_id") % 50 == 0), (odd, F.lit(True)), (empty, F.lit(True))):
        rows = table.select("doc_id", "text").collect()
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        own = [re.findall("[a-z0-9\x80-\U0010ffff]+", (r.text or "").translate(low)) for r in rows]
        n, mean = len(rows), sum(map(len, own)) / max(len(rows), 1)
        df = {t: sum(t in set(o) for o in own) for t in {t for r, o in zip(rows, own) for t in o if len(rows) < 50 or (r.doc_id % 50 == 0)}}
        got = {}
        for r in search.top_k(table, is_query, k=5, shard_rows=40).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
        asked = {r.doc_id: o for r, o in zip(rows, own) if r.doc_id is not None and (len(rows) < 50 or r.doc_id % 50 == 0)}
        for q, terms in asked.items():
            best = {}
            for r, o in zip(rows, own):
                score = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * o.count(t) / (o.count(t) + 1.2 * (0.25 + 0.75 * len(o) / mean)) for t in terms if t in o) if len(terms) < 2000 or n > 50 else None
                if r.doc_id is not None and score:
                    best[r.doc_id] = max(best.get(r.doc_id, 0), round(score, 9))
            if len(terms) < 2000 or n > 50:
                want = sorted(best.items(), key=lambda x: (-round(x[1], 7), x[0]))[:5]
                assert [d for _, d, _ in sorted(got.get(q, []))] == [d for d, _ in want]


def jump(key, n):
    b, j, key = -1, 0, key & ((1 << 64) - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, empty):
    for r in spark.range(-50, 3000).select("id", sharding.jump_hash(F.col("id"), 8).alias("a"), sharding.jump_hash(F.col("id"), 100).alias("b")).collect():
        assert (r.a, r.b) == (jump(r.id, 8), jump(r.id, 100))
    rows = entries.op3_jump_shards(spark, SF).collect()
    for r in rows:
        assert r.shard == jump(r.doc_id, 8) and r.grown_shard == jump(r.doc_id, 9) and r.grown_shard in (r.shard, 8) and r.law == "key"
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    crc = {r.doc_id: (zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(crc[r.doc_id] == (r.text_crc32, r.size) for r in rows)
    placed = sharding.number_slots(sharding.assign_shards(odd, "doc_id", 2).select("doc_id", "shard")).collect()
    assert len(placed) == odd.count() and len({(r.shard, r.slot) for r in placed}) == len(placed)
    assert sharding.number_slots(sharding.assign_shards(empty, "doc_id", 3).select("doc_id", "shard")).count() == 0


def test_repeated_passages(spark, odd, empty):
    passage = prose(55)
    rows = [(i, f"{prose(40)} {passage} {prose(30)}") for i in range(5)] + [(10 + i, prose(150)) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunk_dedup.repeated_spans(table).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 4} and all(r.first_doc_id < r.doc_id for r in found)
    for r in found:
        raw = dict(rows)[r.doc_id].encode()
        assert raw[r.span_start : r.span_end].decode() in dict(rows)[0]
    kept = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(table).collect()}
    assert [passage in kept[i] for i in range(5)] == [True, False, False, False, False] and all(kept[i] == t for i, t in rows if i >= 10 or i == 0)
    out = chunk_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and {0, 1, 2, 3, 4, 5, 6} <= {r.doc_id for r in out.collect()} and chunk_dedup.repeated_spans(empty).count() == 0
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    ends = chunk_dedup.chunk_bounds(data)
    slow = 0
    for i, b in enumerate(data):  # the rolling form of the hash
        slow = ((slow << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        if i >= 31:
            assert (slow ^ int(chunk_dedup.gear_hashes(data[: i + 1])[-1])) & 0xFFFF == 0
    assert ends[-1] == len(data) and (np.diff(np.r_[0, ends]) <= chunk_dedup.MAX_BYTES).all()


def test_spans_are_passages_of_one_document(spark):
    text = prose(60)
    ends = chunk_dedup.chunk_bounds(np.frombuffer(text.encode(), np.uint8))
    pieces = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    # every chunk of the last text stands in an earlier one, but no two of them side by side
    rows = [(i, f"{prose(30)} {p}{prose(30)}") for i, p in enumerate(pieces)] + [(1000, text)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert 1000 not in {r.doc_id for r in chunk_dedup.repeated_spans(table).collect()}
    # without spaces characters count
    han = "".join(chr(0x4E00 + int(x)) for x in RNG.integers(0, 20000, 400))
    other = ["".join(chr(0x4E00 + int(x)) for x in RNG.integers(0, 20000, 100)) for _ in range(2)]
    got = chunk_dedup.repeated_spans(spark.createDataFrame([(1, other[0] + han), (2, other[1] + han)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_doc_id) for r in got] == [(2, 1)] and 200 <= got[0].n_words <= 400
    assert (other[1] + han).encode()[got[0].span_start : got[0].span_end].decode() in han


def brute_spans(rows):
    """All spans of (doc_id, bytes) in order, from runs of chunks compared document by document."""
    wanted, seen = set(), {}
    for doc, raw in rows:
        ends = [0, *chunk_dedup.chunk_bounds(np.frombuffer(raw, np.uint8)).tolist()]
        hit, own = np.zeros(len(ends) - 1, bool), set()
        for i in range(len(ends) - 1):
            for j in range(i + 1, len(ends)):
                passage = raw[ends[i] : ends[j]]
                # words start behind white space; a chunk border may stand inside a word
                n = len(re.findall(rb"(?<![^ \t-\r])[^ \t-\r]", b" " + passage if i == 0 else raw[ends[i] - 1 : ends[j]]))
                if n - (i > 0 and raw[ends[i] - 1 : ends[i]].strip(b" \t\n\v\f\r") != b"") >= 20:
                    hit[i:j] |= passage in seen
                    own.add(passage)
                    if j - i > 12:
                        break
        for p in own:
            seen.setdefault(p, doc)
        edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(int)))
        wanted |= {(doc, ends[a], ends[b]) for a, b in zip(edges[::2], edges[1::2])}
    return wanted


def test_spans_equal_brute_force(spark, docs):
    wanted = brute_spans(sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()))
    got = entries.op4_repeated_spans(spark, SF).collect()
    assert wanted and {(r.doc_id, r.span_start, r.span_end) for r in got} == wanted and len(got) == len(wanted)


def test_nearest_neighbours(spark):
    x = RNG.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (20, x[20].tolist()), (1004, [1.0] * 3), (1005, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, settings=ann.Settings(list_rows=40, group_rows=300, part_rows=50)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for q in range(0, 600, 20):
        score = np.round(x @ x[q], 9)
        score[q] = -np.inf
        want = sorted(range(600), key=lambda i: (-score[i], i))[:20]
        assert q not in got[q] and len(got[q]) == 20
        hits, total = hits + len({*want} & {*got[q]}), total + 20
    assert hits / total >= 0.9
    # lists too small for k rows: further lists make up for it
    few = ann.nearest(table, F.col("vec_id") % 20 == 0, settings=ann.Settings(list_rows=5, search_ratio=1.0)).groupBy("query_id").count()
    assert {(r.query_id, r["count"]) for r in few.collect()} == {(q, 20) for q in range(0, 600, 20)}
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0 and ann.nearest(table.where("vec_id = 1"), F.lit(True)).count() == 0


def test_nearest_on_separate_clusters_and_uneven_lengths(spark):
    """Centroids of other clusters are reached, long vectors are found, and queries unlike the
    other rows are fitted for."""
    rng = np.random.default_rng(11)
    far = np.repeat(rng.normal(size=(12, 16)) * 6, 250, axis=0) + rng.normal(size=(3000, 16))
    uneven = rng.normal(size=(3000, 16)) * rng.lognormal(0, 1.5, size=(3000, 1))
    unlike = rng.normal(size=(3000, 16)) + 4
    unlike[::20] = rng.normal(size=(150, 16)) * 0.01
    for x in (far, uneven, unlike):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(table, F.col("vec_id") % 20 == 0, settings=ann.Settings(list_rows=10, replicas=2)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, 3000, 20):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & got[q])
        assert hits / 3000 >= 0.9, hits / 3000


def test_registered_search_against_brute_force(spark):
    """Recall and scores of the query as registered, and the share of lists that it searches."""
    sf = "/root/testdata/sf0.1"
    rows = ann.usable(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    found = {}
    for r in entries.op5_posting_lists(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, got in found.items():
        score = (x * x[ids == q][0]).cumsum(axis=1)[:, -1]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21)) and all(s == score[ids == v][0] for _, v, s in got)
        assert sorted(got, key=lambda g: (-g[2], g[1])) == got
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:20]
        hits, total = hits + len({ids[i] for i in best} & {v for _, v, _ in got}), total + 20
    assert hits / total >= 0.9
    s = ann.Settings()
    index = ann.fit_centroids(x, max(1, len(x) // s.list_rows), float(np.sqrt((x * x).sum(axis=1).max())), s.neighbours)
    ratio = index.fitted_ratio(x, s, 20)
    share = np.mean([len(index.walk(np.append(q, 0.0), ratio)) for q in x[::20]]) / len(index.points)
    print(f"recall {hits / total:.3f}, ratio {ratio:.3f}, share of lists {share:.2f}")
    assert 1 < ratio and share < 1


def test_every_kind_of_letter_as_the_libraries_have_it():
    import tiktoken
    from tokenizers import Tokenizer

    path = entries.tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library, own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.load(path, public_tokenizers.PATTERN)
    words = entries.tokenizer("word_bpe_49k.json")
    counter, count = token_counts.load(words), Tokenizer.from_file(words)
    edges = [ord(c) for c in bpe.LATER.encode().decode("unicode_escape") if c != "-"]
    for c in {*range(0, 0x110000, 61), *edges, *(e + 1 for e in edges), *token_counts.LOWER_CASE}:
        if not 0xD800 <= c < 0xE000:
            text = f"{chr(c)}'s 1{chr(c)}a{chr(c)}"
            assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode_ordinary(text), hex(c)
            assert counter.total(text)[1] == len(count.encode(text, add_special_tokens=False).ids), hex(c)


def auc(y, x):
    rank = np.argsort(np.argsort(x))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = entries.op7_line_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.95 and (rows.quality == rows.predicted).mean() > 0.93
    model = quality.fit(["fine words here. and more"] * 5 + ["$$$ %%% &&&"] * 5, [1] * 5 + [0] * 5)
    got = quality.score_documents(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == odd.count() and quality.score_documents(empty, model).count() == 0
    assert quality.fit([], []).score(pa.array(["x"]))[0] == pytest.approx(0.5)
    # marginals against all label sequences of a short chain
    scores, ties = RNG.normal(size=4), RNG.normal(size=(2, 2))
    weight = {}
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        weight[tuple(y)] = np.exp(sum(scores[i] * y[i] for i in range(4)) + sum(ties[y[i], y[i + 1]] for i in range(3)))
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(4)]
    assert np.allclose(quality.marginals(scores, np.array([0, 4]), ties), want)


def test_languages_on_held_out_rows(spark, odd, empty):
    rows = entries.op8_language_mixture(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.95
    langs, table = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in langid.predict_languages(odd, langs, table).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[6].lang_pred in langs
    assert langid.predict_languages(empty, langs, table).count() == 0
    none = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict_languages(odd, *none).collect()} == {"und"}
    likely = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10))
    p = langid.mixture(likely, 1.0, 200)
    grid = max(np.linspace(0, 1, 1001), key=lambda a: np.log(np.exp(likely) @ [a, 1 - a]).sum())
    assert abs(p[0] - grid) < 0.01


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_queries_equal_their_sql(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(oracle.SQL[name]).df()
    got = entries.queries()[name](spark, f"/root/testdata/{sf}").toPandas()[list(want.columns)]
    plain = lambda df: sorted((tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False)), key=repr)
    assert len(want) > 0 and plain(got) == plain(want)


def brute_classes(rows):
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            both = rows[i].doc_id is not None and rows[j].doc_id is not None
            if both and (rows[i].doc_id == rows[j].doc_id or (shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared))):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, r in zip(label, rows):
        if r.doc_id is not None:
            least[x] = min(least.get(x, r.doc_id), r.doc_id)
    return sorted((r.doc_id if r.doc_id is not None else -1, len(s), least.get(x, -1)) for x, r, s in zip(label, rows, sets))


def test_near_duplicates_equal_brute_force(odd, empty, docs):
    for table in (odd, docs):
        got = neardup.near_classes(table).collect()
        flat = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)
        assert flat == brute_classes(table.select("doc_id", "text").collect())
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert neardup.near_classes(empty).count() == 0
    kept = neardup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11]


def test_split_buckets_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT_BUCKET", 3)
    got = {(r.doc_id, r.component_id) for r in neardup.near_classes(docs).collect()}
    assert got == {(a, c) for a, _, c in brute_classes(docs.select("doc_id", "text").collect())}


def patched_features(monkeypatch, rows):
    """near_classes sees tuples and sketches made up here; sets stay those of the texts."""
    table = {k: (left, right) for k, left, right in rows}
    mark = bytes([7]) * neardup.BINS

    def features(docs, bands, rows):
        found = [(r.doc_id, 900 + r.doc_id, r.doc_id, r.doc_id, *map(list, table[r.doc_id]), mark) for r in docs.collect()]
        return docs.sparkSession.createDataFrame(found, neardup.FEATURES)

    monkeypatch.setattr(neardup, "features", features)


def test_hot_bucket_keeps_pairs_with_one_shared_tuple(spark, monkeypatch):
    words = prose(110).split()
    rows = [(i, " ".join(words[: 104 + i])) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    patched_features(monkeypatch, [(i, (1, 10 + i), (2, 20 + i)) for i in range(6)])
    monkeypatch.setattr(neardup, "SPLIT_BUCKET", 3)
    assert {r.component_id for r in neardup.near_classes(table, bands=2).collect()} == {0}


def test_pairs_behind_a_failed_sure_pair(spark, monkeypatch):
    # 1 and 2 share 70 of 100 shingles, 3 has all of them; equal sketches take all for certain
    words = prose(104).split()
    rows = [(1, " ".join(words[15:])), (2, " ".join(words[:-15])), (3, " ".join(words))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    patched_features(monkeypatch, [(i, (1, 2), (3, 4)) for i in (1, 2, 3)])
    assert {(r.doc_id, r.component_id) for r in neardup.near_classes(table, bands=2).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_pairs_of_a_family_at_the_threshold_grow_with_it(spark):
    """Copies with two changed words each: about half of all pairs are links, the rest just none."""
    base, rows = prose(60).split(), []
    for i in range(120):
        own = list(base)
        for k in RNG.choice(60, 2, replace=False):
            own[k] = f"w{i}x{k}"
        rows.append((i, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = neardup.features(table, 12, 2).withColumn("_label", F.col("doc_id"))
    pairs, _ = neardup.candidate_pairs(table, nodes, 75, 12)
    want = brute_classes(table.collect())
    assert pairs.count() <= 4 * len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_classes(table).collect()) == want


def test_cells_of_hot_buckets_are_small(spark, monkeypatch):
    base = prose(400).split()
    rows = [(i, " ".join([*base[:200], f"copy{i}", *base[200:]])) for i in range(80)] + [(100 + i, prose(60)) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "SPLIT_BUCKET", 10)
    nodes = neardup.features(table, 12, 2).withColumn("_label", F.col("doc_id"))
    dealt, links = neardup.dealt_rows(table, nodes, 75, 12)
    sizes = [r["count"] for r in dealt.groupBy("_key").count().collect()]
    assert max(sizes, default=0) <= 20 and links.count() >= 70
    assert {(r.doc_id, r.component_id) for r in neardup.near_classes(table).collect()} == {(i, 0 if i < 80 else i) for i, _ in rows}


def test_mix_hits_targets(spark, odd, empty, docs):
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == docs.count() and plan.times.between(0, 2).all()
    by = plan.assign(taken=plan["size"] * plan.times).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"), total=("source_size", "first"))
    assert (by.total == by["size"]).all() and ((by.taken - by.target).abs() <= by.most).all()
    names, left, weights = sorted(by.index), 1.5 * by["size"].sum(), {}
    for i, s in enumerate(names):
        weights[s] = (5, 2, 1)[i % 3]
    want, free = {}, set(names)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] >= 2 * by["size"][s]}
        if not full:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: 2.0 * by["size"][s] for s in full}
        left, free = left - sum(2 * by["size"][s] for s in full), free - full
    assert all(abs(by.target[s] - want[s]) < 1e-6 * want[s] for s in names)
    again = mixing.mix_plan(docs.repartition(3)).toPandas()
    assert sorted(zip(plan.doc_id, plan.times)) == sorted(zip(again.doc_id, again.times))
    assert mixing.mix_documents(docs).count() == plan.times.sum()
    assert mixing.mix_plan(odd).count() == odd.count() and mixing.mix_plan(empty).count() == 0


def test_hypergeometric_follows_its_law(spark):
    n = 4000
    chance = (F.col("id") + 0.5) / n
    long = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(mixing.hypergeometric(long(20), long(7), long(9), chance).alias("k")).groupBy("k").count().toPandas()
    from math import comb

    for k, c in zip(got.k, got["count"]):
        assert abs(c / n - comb(7, k) * comb(13, 9 - k) / comb(20, 9)) < 0.002


def test_mixed_documents_follow_the_plan(odd, empty, docs):
    clash = "_key int, _nth int, _copy int, _draws int, _gone int, _of int, _spans int, _text int, MIX_SHARD int"
    for table in (odd, docs):
        wide = table.select("*", *[F.lit(7).alias(c.split()[0]) for c in clash.split(", ")])
        plan, got = {}, {}
        for r in mixing.mix_plan(wide).collect():
            plan.setdefault(r.doc_id, []).extend(r.shards)
        out = mixing.mix_documents(wide)
        assert out.columns == [*wide.columns[:-1], "mix_shard", "mix_position"]
        for r in out.collect():
            got.setdefault(r.doc_id, []).append(r.mix_shard)
        assert {k: sorted(v) for k, v in plan.items() if v} == {k: sorted(v) for k, v in got.items()}
    assert mixing.mix_documents(empty).count() == 0


def test_equal_rows_at_the_border(spark):
    # one source of equal rows only: the border falls among them
    rows = [(1, "a b c", "s")] * 40 + [(2, "d e", "t")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(table, weights=(1, 9), max_epochs=4).groupBy("source").agg(F.sum("times").alias("n"), F.first("target").alias("t")).collect()
    got = {r.source: r.n for r in mixing.mix_documents(table, weights=(1, 9), max_epochs=4).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert {r.source: r.n for r in plan} == got and all(abs(r.t - got[r.source] * {"s": 3, "t": 2}[r.source]) <= 3 for r in plan)


def test_splitting_tree(spark):
    """Exact quotas, disjoint runs that cover all units, equal shards, and the law of a split."""
    quotas = {1: 37, 2: 5, 3: 0, 4: 58}
    table = spark.createDataFrame(list(quotas.items()), "source_no int, quota long")
    rows = mixing.split_quotas(table, 8, 3).collect()
    for source, quota in quotas.items():
        units = [u for r in rows if r.source_no == source for u in range(r["first"], r["first"] + r["count"])]
        assert sorted(units) == list(range(quota))
    sizes = [sum(r["count"] for r in rows if r.shard == s) for s in range(8)]
    assert sum(sizes) == 100 and max(sizes) - min(sizes) <= 1
    from math import comb

    table = spark.createDataFrame([(1, 6), (2, 4)], "source_no int, quota long")
    counts = np.zeros(6)
    for seed in range(60):
        counts[next(r["count"] for r in mixing.split_quotas(table, 2, seed).collect() if r.shard == 0 and r.source_no == 1)] += 1
    want = np.array([comb(6, k) * comb(4, 5 - k) / comb(10, 5) for k in range(6)])
    assert np.abs(counts / 60 - want).max() < 0.2
    with pytest.raises(ValueError):
        mixing.split_quotas(table, 3, 1)


def test_rows_that_repeat_a_doc_id_keep_their_texts(spark):
    passage, mine, other = prose(60), prose(80), "é" * 7 + " " + prose(150)
    rows = [(1, passage), (2, f"{mine} {passage}"), (2, other), (2, other), (None, passage)]
    clash = [F.lit(0).alias(c) for c in ("_of", "_spans", "_text", "_key", "_gone", "_quality")]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash)
    out = chunk_dedup.remove_repeats(table)
    texts = [r.text for r in out.collect()]
    assert out.columns == table.columns and texts.count(other) == 2 and texts.count(passage) == 2 and len(texts) == 5
    assert all(passage not in t for t in texts if t.startswith(mine))
    kept = neardup.keep_one_of_each(table)
    assert kept.columns == table.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]


def test_repeated_labels(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 1), (4, 2), (6, None)], "doc_id long, quality int")
    model = quality.fit_on_labels(odd, labels)
    assert np.isfinite(model.weights).all() and np.isfinite(model.slope)
    none = quality.fit_on_labels(odd, labels.limit(0))
    assert none.score(pa.array(["x", None]))[0] == pytest.approx(0.5)


def test_stages_on_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert name == "tokens" or out.columns == table.columns
            assert table is odd or not rows
            if name == "tokens":
                assert len(rows) == table.count() and all(r.round_trip for r in rows)


def brute_pipeline(spark):
    """The stages over sf0.001 in plain Python: the model's scores, all pairs of sets, windows
    looked up document by document, targets by water filling, the library's token ids."""
    import corpus_pipeline
    import tiktoken

    path = entries.tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_on_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted(docs.collect())
    good = [r for r in rows if model.score(pa.array([r.text or ""]))[0] >= 0.7]
    yield "quality", {r.doc_id: r.text for r in good}
    first = {d: c for d, _, c in brute_classes(good)}
    kept = [r for r in good if first[r.doc_id] == r.doc_id]
    yield "near_duplicates", {r.doc_id: r.text for r in kept}
    texts = {r.doc_id: (r.text or "").encode() for r in kept}
    spans = brute_spans(sorted(texts.items()))
    cut = {}
    for doc, raw in texts.items():
        at, parts = 0, []
        for a, b in sorted((a, b) for d, a, b in spans if d == doc):
            parts.append(raw[at:a])
            at = b
        rest = b"".join([*parts, raw[at:]])
        if at == 0 or rest.strip(b" \t\n\v\f\r"):
            cut[doc] = rest.decode()
    yield "substrings", cut
    yield "tokens", {doc: library.encode_ordinary(t) for doc, t in cut.items()}


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    want = dict(brute_pipeline(spark))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert {r.doc_id: r.text or "" for r in docs.collect()} == {k: v or "" for k, v in want[name].items()}, name
    times = {r.doc_id: r.times for r in mixing.mix_plan(docs).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {k: v for k, v in times.items() if v} == {d: sum(r.doc_id == d for r in got) for d in {r.doc_id for r in got}}
    assert all(list(r.tokens) == want["tokens"][r.doc_id] and r.n_tokens == len(r.tokens) and r.round_trip for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0


def test_prefix_tables_hold_every_count(spark):
    """What is stored gives the library's count of every prefix and the cut at any budget."""
    from tokenizers import Tokenizer

    path = entries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.load(path)
    texts = ["", " ", "it's they'll we've 'r 're", "unbelievable  12345\tÜbergrößen ﬁn", "a<|endoftext|>b  <|endoftext", "x" * 300, "\n\nnaïve été!! ?!", "中文字 🙂🙂", None]
    rows = token_counts.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), path, limit=5).collect()
    for r in rows:
        normal = "".join(p if special else counter.normal(p) for p, special in counter.parts(r.text or ""))
        counts = token_counts.counts_of(bytes(r.prefix_steps))
        assert len(counts) == len(normal) + 1
        assert counts.tolist() == [len(library.encode(normal[:i], add_special_tokens=False).ids) for i in range(len(normal) + 1)], r.text
        assert r.n_tokens == counts[-1] and r.over_limit == (r.n_tokens > 5)
        within = [i for i in range(len(counts)) if counts[: i + 1].max() <= 5]
        assert r.chars_within_limit == within[-1]


def test_many_languages(spark):
    words = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join([w] * 5), f"l{i:03}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    langs, table = langid.learn(docs)
    assert len(langs) == 300 and table.shape[0] == 300
    got = langid.predict_languages(docs, langs, table).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 290


def test_scratch_deletes_its_own(spark):
    import threading

    from chartweave.llm import _shared

    other = []
    with _shared.scratch():
        worker = threading.Thread(target=lambda: other.append(_shared.stash(spark.range(3).toDF("id"), "other")))
        worker.start()
        worker.join()
        mine = _shared.stash(spark.range(2).toDF("id"), "mine")
        assert mine.count() == 2
    assert other[0].count() == 3 and mine not in _shared._folder_of
    _shared.drop(*other)


def test_hot_buckets_without_broadcasts(docs, monkeypatch):
    """Beyond the bound the same classes come out of joins by shuffle."""
    monkeypatch.setattr(neardup, "SPLIT_BUCKET", 3)
    some = docs.where("doc_id < 120")
    want = {(r.doc_id, r.component_id) for r in neardup.near_classes(some).collect()}
    monkeypatch.setattr(neardup, "FEW_ROWS", 0)
    assert {(r.doc_id, r.component_id) for r in neardup.near_classes(some).collect()} == want
