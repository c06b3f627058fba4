"""Each operator against a plain computation on small tables, and the defined results of odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.llm import ann, bpe, chat, components, decontam, entries, line_dedup, lm_score, near_copies, quality, sharding, simhash, token_files

ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "one two"), (6, "Ein Wort für Wort ß É"), (7, "one two"), (7, "one two"), (None, "one two three four five six"),
    (8, "x" * 70_000), (9, "ab " * 30_000), (10, " odd\x1c space\x85 here 　 end "), (11, "<|endoftext|> 'll we'RE 12345 !!! ..."), (12, "line\n\n\nline\r\n  tail\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", 5, "clash") for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, shard string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.filter("false")


# 1
def test_lm_score_prefers_target_like_texts(spark):
    rows = [(k, "good words make good text " * 5) for k in range(20)] + [(k, "bad noise makes bad junk " * 5) for k in range(20, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(d, d.filter("doc_id < 10").select("doc_id")).collect()}
    assert max(out[k] for k in range(20)) < min(out[k] for k in range(20, 60))


@pytest.mark.parametrize("frequent", [500_000, 3])
def test_lm_score_odd_rows(odd, frequent):
    out = lm_score.cross_entropy_difference(odd, odd.filter("doc_id = 5").select("doc_id"), frequent=frequent).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) - 1  # the repeated row is one
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0 and by[1].score == 0 and by[1].target_loss is None
    assert by[9].n_tokens == 30_000 and by[5].score == by[7].score < by[4].score
    assert lm_score.cross_entropy_difference(empty(odd), odd.select("doc_id")).count() == 0


def test_lm_score_rare_bigrams_join_like_frequent_ones(docs):
    ids = docs.filter("doc_id % 3 = 0").select("doc_id")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in lm_score.cross_entropy_difference(docs, ids, frequent=n).collect()) for n in (500_000, 50))
    assert a == b


def plain_scores(texts, target, words=50_000):
    split = {k: t.encode().lower().split() for k, t in texts.items()}
    everything = Counter(x for w in split.values() for x in w)
    cls = {x: x if n >= (1 / words) * sum(everything.values()) else b"" for x, n in everything.items()}
    before, loss = {k: [None, *map(cls.get, w)][: len(w)] for k, w in split.items()}, {}
    for name, ids in (("t", target), ("b", set(texts))):
        own = Counter(x for k in ids for x in split[k])
        c = Counter(p for k in ids for p in zip(before[k], map(cls.get, split[k]), strict=True))
        cv, cw, n = Counter(), Counter(), max(sum(own.values()), 1)
        for (v, w), m in c.items():
            cv[v] += m
            cw[w] += m

        def one(v, x, own=own, c=c, cv=cv, cw=cw, n=n):
            share = 0.6 * c[v, cls[x]] / cv[v] * own[x] / max(cw[cls[x]], 1) + 0.35 * own[x] / n if cv[v] else 0.95 * own[x] / n
            return -np.log(share + 0.05 / (len(everything) + 1))

        loss[name] = one
    return {k: np.mean([loss["t"](*x) - loss["b"](*x) for x in zip(before[k], w, strict=True)]) if w else 0 for k, w in split.items()}


@pytest.mark.parametrize(("words", "frequent"), [(50_000, 500_000), (50_000, 50), (300, 3)])
def test_lm_score_tells_every_word_apart(spark, docs, words, frequent):
    # 60,000 tokens of one word make each word met once rarer than 1 in 50,000
    texts = {1: "common " * 60_000, 2: "rare alpha", 3: "rare beta", 4: "rare alpha", 5: "rare gamma", 6: ""}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(d, d.filter("doc_id = 4").select("doc_id"), words=words, frequent=frequent).collect()}
    assert out[2] < out[3] and out == pytest.approx(plain_scores(texts, {4}, words), abs=1e-9)
    texts = {r.doc_id: r.text or "" for r in docs.filter("doc_id is not null").collect()}
    ids = docs.filter("doc_id % 3 = 0").select("doc_id")
    got = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(docs.filter("doc_id is not null"), ids, words=words, frequent=frequent).collect()}
    assert got == pytest.approx(plain_scores(texts, {k for k in texts if k % 3 == 0}, words), abs=1e-9)


# 2
def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in quality.op2_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.95


def test_quality_scores_are_log_density_ratios(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.filter("doc_id is not null").select("doc_id", "text").collect()
    x = {r.doc_id: quality.text_statistics(pa.array([r.text], pa.string()))[0] for r in rows}
    train = [k for k in x if k in known and zlib.crc32(str(k).encode()) % 4 != 2]
    y = np.array([known[k] for k in train])
    z = np.array([x[k] for k in train])
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        own = 0.98 * cov[c] + 0.02 * pooled
        own = 0.998 * own + np.eye(z.shape[1]) * 0.002 * np.trace(own) / z.shape[1]
        inverse, mean, prior = np.linalg.inv(own), z[y == c].mean(axis=0), ((y == c).sum() + 1) / (len(y) + 2)
        logs.append({k: np.log(prior) - (v - mean) @ inverse @ (v - mean) / 2 - np.linalg.slogdet(own)[1] / 2 for k, v in x.items()})
    want = {k: 1 / (1 + np.exp(np.clip(logs[0][k] - logs[1][k], -500, 500))) for k in x}
    got = {r.doc_id: r for r in quality.op2_quality(spark, "/root/testdata/sf0.001").collect()}
    assert {k: got[k].score for k in want} == pytest.approx(want, abs=1e-6)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality_statistics_by_hand():
    text = "Aa bb bb! 12\n cc"
    x = dict(zip(quality.FEATURES, quality.text_statistics(pa.array([text]))[0], strict=True))
    share = lambda part, whole: np.arcsin(np.sqrt(part / whole))
    size, words = len(text) + quality.EXTRA_BYTES, [2, 2, 3, 2, 2]
    assert x["upper"] == pytest.approx(share(1, size)) and x["digit"] == pytest.approx(share(2, size)) and x["line"] == pytest.approx(share(1, size)) and x["shout"] == pytest.approx(share(1, size))
    assert x["word_length"] == pytest.approx((sum(np.log(words)) + 8 * 1.5) / 13) and x["short_words"] == pytest.approx(share(5 + 8 * 0.35, 13)) and x["repeats"] == 0


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.with_score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["_score"] <= 1 for r in out)
    assert quality.with_statistics(odd.withColumn("features", F.lit(1))).columns[-1] == "_features"
    none = quality.fit(empty(odd), empty(labels))
    assert {round(r["_score"], 6) for r in quality.with_score(odd, none).collect()} == {0.5}


# 3
def brute_fingerprint(text, words=3):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash_against_brute_force(docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{fp:016x}", rows[c].doc_id) for r, fp, c in zip(rows, fps, brute_components(fps, 3), strict=True)}
    got = {(r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_simhash_links_dense_values(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for c in centres for k in (0, 1, 2, 3, 5) for _ in range(3)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "v long"), 3, tile)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    brute = brute_components([v & (1 << 64) - 1 for v in values], 3)
    assert [roots.get(v, v) for v in values] == [values[c] for c in brute]


def test_simhash_odd_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {(0, 1)} and by[7] == {(next(iter(by[5]))[0], 5)}
    assert simhash.with_fingerprints(odd.withColumn("fingerprint", F.lit(1))).columns[-1] == "_fingerprint"
    assert len(by[None]) == 1 and simhash.near_duplicates(empty(odd)).count() == 0
    kept = Counter(r.doc_id for r in simhash.keep_first(odd).collect())
    assert 2 not in kept and 3 not in kept and 7 not in kept and kept[5] == 1


def test_near_copies_against_all_pairs(spark, docs):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "null id"), (10_000, "null id"), (10_001, " "), (10_002, None)]
    for k in range(60):  # up to 20 changed words, so similarities on both sides of 0.8
        changed = list(base)
        for at in rng.integers(0, 300, k // 3):
            changed[at] = f"x{k}"
        rows.append((20_000 + k, " ".join(changed)))
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                root = [root[a] if r == root[b] else r for r in root]
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    want = {(rows[k][0], rows[min((j for j in range(len(rows)) if root[j] == root[k]), key=order)][0]) for k in range(len(rows))}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_copies.near_copies(d).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, d, None).collect()}
    assert kept == {c for _, c in want} and near_copies.near_copies(empty(d)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901), (5, 5)], "src long, dst long")
    out = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert out == {**{k: 0 for k in range(201)}, 900: 900, 901: 900}
    assert components.connected_components(edges.filter("false")).count() == 0


# 4
def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in ann.op4_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    at = {v: k for k, v in enumerate(ids)}
    assert set(got) == {v for v in ids.tolist() if v % 20 == 0}
    for q, found in got.items():
        exact = x @ x[at[q]]
        order = [v for v in sorted(ids.tolist(), key=lambda v: (-exact[at[v]], v)) if v != q][:20]
        hit, total = hit + len({v for _, v, _ in found} & set(order)), total + len(order)
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert all(abs(s - exact[at[v]]) < 1e-9 for _, v, s in found)
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda p: (-p[1], p[0]))
    assert hit / total >= 0.9


def recall(rows, got, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found, hit, total = defaultdict(set), 0, 0
    for r in got:
        found[r.query_id].add(r.vec_id)
    for at in np.flatnonzero(ids % 20 == 0):
        exact = x @ x[at]
        exact[at] = -np.inf
        want = set(ids[np.argsort(-exact, kind="stable")[:k]].tolist())
        assert len(found[int(ids[at])]) == len(want)
        hit, total = hit + len(want & found[int(ids[at])]), total + len(want)
    return hit / total


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_neighbours_of_vectors_of_unlike_length(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    x *= rng.choice([0.01, 0.3, 1.0], 3000)[:, None]
    x[7] *= 60
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    d = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    assert recall(rows, ann.nearest(d, F.col("vec_id") % 20 == 0).collect()) >= 0.9


def test_neighbours_visit_less_where_vectors_lie_in_clusters(spark):
    from tidegrid.llm.common import stored

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 64))
    made = {}
    for name, x in (("uniform", rng.normal(size=(4000, 64))), ("clusters", centres[rng.integers(0, 100, 4000)] + 0.2 * rng.normal(size=(4000, 64)))):
        x /= np.sqrt((x**2).sum(axis=1))[:, None]
        g = stored(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "rep long, e array<double>"))
        made[name] = ann.fitted(g, g.filter("rep % 20 = 0"), 20)
    assert all(m["recall"] >= 0.9 and m["products"] < 1 for m in made.values()) and made["clusters"]["share"] < 0.2 < made["uniform"]["share"]


def test_neighbours_score_in_the_columns_own_type(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0000000001])], "vec_id long, embedding array<double>")
    assert [r.score for r in ann.nearest(d, F.col("vec_id") == 0).collect()] == [1.0 * 2.0 + 2.0 * 1.0000000001]


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (20, [0.5, 0.5]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (40, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(d, F.col("vec_id") % 20 == 0).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert ann.nearest(d.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


# 5
@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1), st.sampled_from([0, (1 << 60) - 1, (1 << 60) - 2, (1 << 64) - 1])), max_size=900))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert token_files.decode_words(token_files.encode_words(v)).tolist() == v.tolist()


def test_simple8b_packs():
    assert len(token_files.encode_words(np.zeros(480, np.uint64))) == 2
    assert len(token_files.encode_words(np.full(600, 50_000, np.uint64))) == 200  # 16 bits: three in a word


def test_token_files_against_the_library(spark, odd, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    added = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "two  <|endoftext|>\n\n<|endoftext|>z a"), (3, "plain words"), (4, None), (5, "<|endoftext|>"), (6, "<|endoftext |>")], "doc_id long, text string")
    for frame in (odd, added, docs):
        rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        path = token_files.write_token_files(frame, vocabularies.path("byte_bpe_50k.json"))
        got = sorted(((r.start, r.doc_id, bytes(r.tokens)) for r in token_files.read_token_files(spark, path).collect()))
        at, want = 0, []
        for k, text in rows:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            want.append((at, k, np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert got == want
    path = token_files.write_token_files(empty(odd), vocabularies.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


# 6
def test_bpe_against_the_library(odd, docs):
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for frame in (odd, docs):
        out = bpe.decode(bpe.encode(frame, path, vocabularies.PATTERN), path).collect()
        for r in out:
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
            assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(empty(odd), path, vocabularies.PATTERN).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_bpe_any_text(texts):
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, edges = bpe.encoder(path, vocabularies.PATTERN)(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


# 7
def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "one two three four five six"), (5, "Ab aB ab ab ab"), (None, "a")], "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench, least_words=1).collect()}
    assert out == {(5, 1), (7, 1), (None, 1), (None, 4), (9, 5), (4, None)}
    assert {r.doc_id for r in decontam.decontaminate(odd, bench, least_words=1).collect()} == {1, 2, 3, 6, 8, 10, 11, 12}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()} == {(None, 4), (9, 5)}
    assert {r.doc_id for r in decontam.decontaminate(odd, bench).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12}
    copies = bench.filter("item_id = 4").withColumn("more", F.explode(F.sequence(F.lit(3), F.lit(40)))).select((F.col("item_id") + F.col("more")).alias("item_id"), F.concat(F.lit(" "), "text").alias("text"), F.lit(1).alias("__doc"))
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(odd, copies).collect()] == [(None, 7)]
    assert decontam.contaminated(empty(odd), bench).count() == 0 and decontam.contaminated(odd, bench.filter("false")).count() == 0


def test_decontamination_planted(spark):
    item = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"z{k}" for k in range(20_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = " ".join(item.split()[:30])
    d = spark.createDataFrame([(1, f"{long} {item.upper()} {long}"), (2, f"{long} {half}"), (3, long), (4, item.replace("w30", "x"))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(d, bench).collect()} == {1, 4}


def test_decontamination_keeps_texts_of_one_item_id_apart(spark):
    short, long = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("s", 14), ("l", 54)))
    bench = spark.createDataFrame([(None, short + " a"), (None, long + " a"), (1, short), (1, long), (1, short)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"before {short} after"), (2, "clean text of its own words"), (3, " ".join(long.split()[:20])), (4, long)], "doc_id long, text string")
    out = {(r.doc_id, r.item_id, r.shingles, r.held, r.containment) for r in decontam.contaminated(d, bench).collect()}
    assert out == {(1, None, 11, 10, 10 / 11), (1, 1, 10, 10, 1.0), (4, None, 51, 50, 50 / 51), (4, 1, 50, 50, 1.0)}
    assert {r.doc_id for r in decontam.decontaminate(d, bench).collect()} == {2, 3}


# 8
def test_line_dedup_removes_shared_passages(spark):
    passage = "\n".join(f"shared line {k} of the passage with some words in it" for k in range(12))
    rows = [(k, "\n".join([f"own line {j} of text {k} and nothing else" for j in range(k)] + [passage] + [f"tail {j} of {k}" for j in range(5)])) for k in range(1, 9)]
    one = " ".join(f"word{k}" for k in range(60))
    rows += [(20, f"start here\n{one}\nend"), (21, f"{one}"), (22, "clean text\nof two lines"), (23, None), (24, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(d).collect()}
    assert out[1] == dict(rows)[1] and out[20] == dict(rows)[20] and out[22] == dict(rows)[22] and out[23] is None and out[24] == ""
    assert out[21] == ""
    for k in range(2, 9):
        assert sum(f"shared line {j} " in out[k] for j in range(12)) <= 4 and f"own line 0 of text {k}" in out[k] and f"tail 4 of {k}" in out[k]


@pytest.mark.parametrize("size", [2, 3, 4, 6, 8])
def test_line_dedup_removes_short_passages_whole(spark, size):
    rows = []
    for k in range(40):  # each passage in two documents of other lines
        passage = [f"passage {k} line {j} " + "of nineteen words " * 5 for j in range(size)]
        rows += [(2 * k + d, "\n".join([f"before {k} {d}", *passage, f"after {k} {d}"])) for d in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n) for r in line_dedup.remove_repeats(d, removed_col="n").collect()}
    assert out == {k: (t, 0) if k % 2 == 0 else (f"before {k // 2} 1\nafter {k // 2} 1", size) for k, t in rows}


def brute_lines(rows, words=50):
    """Each text without the lines of what occurs before: pairs of neighbouring lines, and long lines."""
    first, out = {}, {}
    for k, text in sorted(rows):
        lines, gone = (text or "").split("\n") if text else [], set()
        for at in range(len(lines)):
            for span in (2, 1):
                part = tuple(lines[at : at + span])
                if len(part) < span or (span == 1 and len([w for w in part[0].replace("\x0b", " ").split(" ") for w in w.split()]) < words):
                    continue
                if first.setdefault(part, (k, at)) != (k, at):
                    gone.update(range(at, at + span))
        out[k] = "\n".join(x for at, x in enumerate(lines) if at not in gone) if text else text
    return out


def test_line_dedup_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs).collect()}
    assert got == brute_lines(rows) and any(len(got[k] or "") < len(t or "") for k, t in rows)


def test_line_dedup_odd_rows(odd):
    out = line_dedup.remove_repeats(odd, removed_col="n")
    assert out.columns == [*odd.columns, "n"] and out.count() == len(ODD)
    assert Counter((r.doc_id, r.text, r.n) for r in out.collect()) == Counter((k, t, 0) for k, t in ODD)
    assert line_dedup.remove_repeats(odd, removed_col="score").columns == [*odd.columns, "_score"]
    assert line_dedup.remove_repeats(empty(odd)).count() == 0
    nulls = odd.sparkSession.createDataFrame([(None, "a\nb\nc"), (None, "x\na\nb"), (3, "a\nb"), (3, "z\nx\na\nb")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.remove_repeats(nulls).collect())
    assert got == [(0, "a\nb\nc"), (0, "x"), (3, ""), (3, "z")]  # rows of one id, the null id too, are one document


# 9
def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi <b> \\\\l \\"q\\""},{"role":"assistant","content":"</turn>\\n ok"}]}', '{"prompt":"p","completion":"c"}',
        '{"instruction":"i","input":"x","output":"o"}', '{"instruction":"i","input":"","output":"o"}', '{"conversations":[{"from":"Human","value":"a"},{"from":"gpt","value":null}]}', '{"zzz":1}', "no json", None, '{"turns":[]}',
        '{"id":7,"prompt":"p","meta":{"completion":1},"completion":"c"}', '{"messages":[{"role":"user","content":"a","name":"n"},{"content":"b"}],"model":"m"}', '{"messages":[{"role":"Assistant","content":"a"}]}', "[1]", "",
        '{"messages": [ ]}', '{"prompt":"p","completion":"%s"}' % ("long " * 100_000),
    ]
    d = spark.createDataFrame([(k, r, "clash") for k, r in enumerate(records)], "k int, record string, layout string")
    out = {r.k: r for r in chat.format_records(d).withColumn("back", chat.parsed_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    turns = lambda k: [(t.role, t.text) for t in out[k].back]
    assert turns(0) == [("user", 'hi <b> \\l "q"'), ("assistant", "</turn>\n ok")] and out[0].loss == "</turn>\n ok"
    assert turns(1) == [("user", "p"), ("assistant", "c")] and turns(2)[0][1] == "i\n\nx" and turns(3)[0][1] == "i"
    assert turns(4) == [("user", "a"), ("assistant", "")]
    assert out[5]["_layout"] is None and out[6].formatted is None and out[7].formatted is None
    assert out[8].formatted == "" == out[8].loss and out[8]["_layout"] == "turns" and out[8].back == out[8].loss_spans == []
    assert turns(9) == [("user", "p"), ("assistant", "c")] and turns(10) == [("user", "a"), ("", "b")]
    assert turns(11) == [("Assistant", "a")] and out[11].loss == "" and out[12].formatted is None and out[13].formatted is None
    assert out[14].formatted == "" and out[15].loss == "long " * 100_000
    assert chat.format_records(empty(d)).count() == 0


def test_chat_layouts_with_fields_of_others(spark):
    records = [
        '{"system":"s","messages":[{"role":"user","content":"a"}]}', '{"input":"x","messages":[{"role":"user","content":"a"}]}', '{"conversations":[{"from":"human","value":"a"}],"system":"s"}',
        '{"prompt":"p","response":"r","completion":"c"}', '{"prompt":"p","completion":"c","output":"o"}', '{"messages":[{"role":"user"},{"role":"assistant","content":"b"}]}', '{"system":"","messages":[{"role":"user","content":"a"}]}',
        '{"messages":"text","prompt":"p","response":"r"}', '{"system":"s","messages":[]}', '{"messages":[1,null]}', '{"messages":{"role":"user","content":"x"}}',
    ]
    d = spark.createDataFrame([(k, r, 1) for k, r in enumerate(records)], "k int, record string, paths int")
    made = chat.format_records(d)
    assert made.columns == ["k", "record", "paths", "layout", "loss_spans", "formatted"]
    out = {r.k: [(t.role, t.text) for t in r.back] if r.back is not None else None for r in made.withColumn("back", chat.parsed_turns(F.col("formatted"))).collect()}
    user = ("user", "a")
    assert out == {
        0: [("system", "s"), user], 1: [user], 2: [("system", "s"), user], 3: [("user", "p"), ("assistant", "c")], 4: [("user", "p"), ("assistant", "c")], 5: [("user", ""), ("assistant", "b")], 6: [user],
        7: [("user", "p"), ("assistant", "r")], 8: [("system", "s")], 9: None, 10: None,
    }


def test_chat_rows_of_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "assistant", "z"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, None, None, "t"), (2, 5, "user", "x" * 200_000), (None, 3, "user", "u"), (None, 2, "user", "v")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    made = chat.format_records(chat.records_of_turns(d)).withColumn("back", chat.parsed_turns(F.col("formatted")))
    out = {r.conv_id: [(t.role, t.text) for t in r.back] for r in made.collect()}
    assert out == {
        1: [("assistant", "a"), ("assistant", "a"), ("assistant", "z"), ("user", ""), ("assistant", "b")], 2: [("", "t"), ("user", "x" * 200_000)], None: [("user", "v"), ("user", "u")],
    }
    assert chat.records_of_turns(empty(d)).count() == 0


# 10
def test_sharding_law(spark, odd):
    out = sharding.shuffle_into_shards(odd, shards=4, bucket_bytes=50_000).collect()
    assert len(out) == len(ODD) and Counter((r.doc_id, r.text) for r in out) == Counter(ODD)
    by = defaultdict(list)
    for r in out:
        by[r["_shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shuffle_into_shards(empty(odd)).count() == 0
    clash = odd.withColumn("__bucket", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("place", F.lit(3)).withColumn("b", F.lit(4)).withColumn("start", F.lit(5))
    again = sharding.shuffle_into_shards(clash, shards=4, bucket_bytes=50_000)
    assert again.columns == [*clash.columns, "_shard", "slot"] and again.count() == len(ODD) and {(r["__bucket"], r.bucket, r.place, r.b, r.start) for r in again.collect()} == {(1, 2, 3, 4, 5)}


def test_shards_are_folders(spark, docs):
    import tempfile

    path = tempfile.mkdtemp() + "/shards"
    sharding.shuffle_into_shards(docs, bucket_bytes=20_000, path=path)
    one = spark.read.parquet(f"{path}/shard=3")
    assert one.columns == [*docs.columns, "slot"] and abs(one.count() - docs.count() / 24) < 1


def test_sharding_order_depends_on_seed(docs):
    order = lambda seed: [r.doc_id for r in sorted(sharding.shuffle_into_shards(docs, seed=seed).collect(), key=lambda r: (r["slot"], r["shard"]))]
    a = order(1)
    assert a == order(1) != order(2) and abs(np.corrcoef(np.arange(len(a)), a)[0, 1]) < 0.3


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entries.SQL[name]).to_arrow_table()
    got = entries.QUERIES[name](spark, sf).toArrow().select(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in t.column_names), strict=True)))
    assert rows(got) == rows(want)


def test_query_digests(spark, sf, docs):
    import tiktoken
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    run = lambda name: {r.doc_id: r for r in entries.QUERIES[name](spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = run("op3_simhash")
    assert {k: r.fingerprint for k, r in out.items()} == {k: f"{brute_fingerprint(t):016x}" for k, t in texts.items()} and all(r.component_id <= k for k, r in out.items())
    library, at, want = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json")), 0, {}
    for k in sorted(texts):
        ids = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {k: (r.start, r.n_tokens, r.ids_crc32) for k, r in run("op5_token_files").items()} == want
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    ids = {k: np.array(library.encode_ordinary(t), "<u4") for k, t in texts.items()}
    assert {k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for k, r in run("op6_bpe").items()} == {k: (len(x), sha(x.tobytes()), sha(texts[k].encode())) for k, x in ids.items()}
    kept = brute_lines(list(texts.items()))
    lines = lambda t: len(t.split("\n")) if t else 0
    out = run("op8_line_dedup")
    assert {k: (r.kept_chars, r.kept_sha256) for k, r in out.items()} == {k: (len(t), sha(t.encode())) for k, t in kept.items()}
    assert all(r.removed_lines == lines(texts[k]) - lines(kept[k]) for k, r in out.items() if kept[k])
    out = run("op10_sharding")
    assert {k: (r.size, r.text_crc32, r.law, r.grown_shard) for k, r in out.items()} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None) for k, t in texts.items()}
    places = defaultdict(set)
    for r in out.values():
        places[r.shard].add(r.slot)
    assert sorted(places) == list(range(24)) and all(v == set(range(len(v))) for v in places.values()) and len({len(v) for v in places.values()}) <= 2


def test_pipeline_stages_on_odd_rows(spark, sf, odd):
    import corpus_pipeline

    names = lambda d: sorted(f.name for f in d.schema.fields)
    for d in (odd, empty(odd)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, d, sf)
            assert names(out) == names(d) and out.count() <= d.count()
    kept = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, odd, sf).collect()}
    assert kept == {None, 1, 4, 5, 6, 8, 9, 10, 11, 12}
    assert len(corpus_pipeline.quality_classifier(spark, odd, sf).columns) == len(odd.columns)
    assert corpus_pipeline.byte_level_bpe(spark, odd, sf).count() == len(ODD)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0.5 * n < d.count() <= n
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == d.count() and all(len(r.ids_sha256) == 64 for r in out)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in out)
