"""Operators 11 to 13 against plain computations, and the defined results of odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import codes, repair, rules

SHAPE = re.compile(r"(s?(ua)+)?")


# 11
def plain_repair(turns):
    """The least (cost, audit) of all edits, by search over states; turns: kinds as in repair._chunk."""
    best = {"": (0, "")}
    grow = lambda at: {k: v for k, v in at.items()}

    def better(at, state, value):
        if state not in at or value < at[state]:
            at[state] = value

    def inserted(at):
        for _ in range(3):
            for state, (c, e) in list(at.items()):
                better(at, "a" if state == "u" else "u", (c + 2, e + "I"))
        return at

    best = inserted(grow(best))
    for kind in turns:
        new = {}
        for state, (c, e) in best.items():
            better(new, state, (c + 3, e + "D"))
            if kind == "d":
                continue
            more, after = int(kind.isupper()), "a" if state == "u" else "u"
            better(new, after, (c + 2 + more, e + "R"))
            if kind.lower() == after or (kind.lower() == "s" and state == ""):
                better(new, kind.lower(), (c + more, e + "K"))
        best = inserted(new)
    return min(v for s, v in best.items() if s in ("", "a"))


def test_matrices_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        kinds = "".join(rng.choice("suaoSUAOd") for _ in range(rng.randrange(0, 40)))
        assert repair.cheapest(repair.matrix_of(kinds)) == plain_repair(kinds), kinds
    for kinds in map("".join, itertools.product("suaUd", repeat=4)):
        assert repair.cheapest(repair.matrix_of(kinds)) == plain_repair(kinds)


def plain_report(rows):
    """rows of one conversation: (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(q[2].encode()).digest()))
    seen, kinds, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not blank and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        seen.add((role, text))
        low = role[:1] if role[:1] in ("s", "u", "a") else "o"
        kinds += "d" if blank or again else low.upper() if cut else low
        if fault := "blank" if blank else "duplicate" if again else "truncated" if cut else None:
            faults[fault] += 1
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_repair(kinds)
    out, state, at = [], "", 0
    for edit in audit:
        after = {"a": "assistant", "u": "user"}["a" if state == "u" else "u"]
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit != "D":
            out.append((role if edit == "K" else after, text, edit))
            state = out[-1][0][0]
    assert SHAPE.fullmatch("".join(r[0] for r, _, _ in out))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *faults.values(), illegal, cost, audit), out


def odd_conversations():
    rng = random.Random(5)
    texts = ["a.", "b!", "c", "", " \n", None, "d?  ", "ß. ", "x" * 50_000, "e\x1c"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)) for c in range(40) for _ in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "n.") for t in (1, 1, 3)] + [(99, 0, "user", "only")] * 5
    # one that spans all partitions
    return rows + [(77, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}{rng.choice('.!c')}") for t in range(3000)]


def test_repair_equals_plain_computation(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"state": F.lit("clash"), "position": F.lit(1), "conv": F.lit(2)}).repartition(7)
    made = repair.repair(df)
    by = {}
    for r in made.orderBy("position").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert set(by) == {r[0] for r in rows}
    for conv, found in by.items():
        report, turns = plain_report([r[1:] for r in rows if r[0] == conv])
        assert tuple(found[0][c] for c in (*repair._NUMBERS, "audit")) == report, conv
        assert [(r.role, r.text, r.edit) for r in found[1:]] == turns
    digests = {r.conv_id: r.repaired_sha256 for r in repair.with_digest(made).collect()}
    assert digests == {c: hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found[1:]).encode()).hexdigest() for c, found in by.items()}


def test_repair_without_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 3)], "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: r for r in repair.with_digest(repair.repair(df, copies="copies")).collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].duplicate, got[2].illegal, got[2].cost, got[2].audit) == (2, 2, 8, "KDDI")
    assert repair.with_digest(repair.repair(df.filter("false"), copies="copies")).count() == 0


# 12
def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


TEXTS = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x\nx\n x\n\n\nx", "ä ß 世界 #*$%&|<> é", "1 1 1 1 1 1 1 1", "one\x1ctwo \x85 three", "a b c d e f\n" * 20, "w" * 70_000, "q r s t u v " * 40]


def test_counts_equal_plain_ones():
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("ab \nc#é") for _ in range(rng.randrange(300))) for _ in range(150)]
    got = np.column_stack(rules.text_counts(pa.array(texts, pa.string())))
    assert got.tolist() == [plain_counts(t) for t in texts]
    assert np.column_stack(rules.text_counts(pa.array(texts, pa.string()).slice(3, 5))).tolist() == got[3:8].tolist()


def test_rules_on_odd_rows(spark):
    rows = [(k, t, None if k % 2 else "en", "s", "clash") for k, t in enumerate(TEXTS)] + [(None, "a b", "en", None, ""), (3, "a", "en", "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    counts = rules.with_counts(df)
    assert counts.columns == [*df.columns, "_n_words", *rules.COUNTS[1:]] and counts.count() == len(rows)
    counts = rules.with_counts(df.drop("n_words"))
    for d in (counts, counts.filter("false")):
        out = rules.with_verdicts(d, rules.thresholds(d))
        assert out.columns == [*d.columns, "base_failed", "kept"] and out.count() == d.count()
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.with_verdicts(counts, rules.thresholds(counts)).collect()}
    assert got[0] == got[3] == (True, False) and got[5] == (True, False)


def test_groups_set_their_own_thresholds(spark):
    text = lambda n, seed: " ".join(f"{'w' * n}{seed * 31 + k}" for k in range(40))
    rows = [(k, text(3, k), "en", "a") for k in range(60)] + [(100 + k, text(20, k), "en", "b") for k in range(60)] + [(200, text(20, 7), "en", "a"), (201, text(3, 7), "en", "b"), (202, "# $ & " * 3 + text(3, 9), "en", "a"), (203, text(3, 11), "en", "few"), (204, text(4, 1), "fr", "few")]
    counts = rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    gone = {r.doc_id for r in rules.with_verdicts(counts, rules.thresholds(counts)).filter("not kept").collect()}
    assert gone == {200, 201, 202}


def test_merged_sketches_are_those_of_the_whole(spark, sf):
    counts = rules.with_counts(spark.read.parquet(f"{sf}/documents.parquet")).drop("text")
    one = lambda d: rules.sketches(d, ["lang"])
    parts = one(counts.filter("doc_id % 3 = 0")).union(one(counts.filter("doc_id % 3 <> 0"))).groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(parts.collect()) == sorted(one(counts).select(*parts.columns).collect())
    quart = {r.lang: (r.low, r.high) for r in rules.quartiles(one(counts), ["lang"]).filter("rate = 'length'").collect()}
    fine = counts.filter(~rules.base_failed(F.col("n_words"), F.col("n_repeat_words")))
    for lang, (low, high) in quart.items():
        values = sorted(r.v for r in fine.filter(F.col("lang") == lang).select(rules.rate("length").alias("v")).collect())
        for got, share in ((low, 1), (high, 3)):
            true = values[math.ceil(share * len(values) / 4) - 1]
            assert true * 63 / 64 - 1 <= got <= true


# 13
def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(v * 256) for v in r[1]] for r in kept]
    size = len(x[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in x]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(books[p])]
    return sorted((r[0] if r[0] is not None else -1, bytes(near(v[p], books[p])[1] for p in range(parts)), sum(near(v[p], books[p])[0] for p in range(parts)), r[2]) for r, v in zip(kept, cut, strict=True)), books


@pytest.mark.parametrize("dims", [16, 48])
def test_codes_equal_plain_ones(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(k), [float(np.float32(v)) for v in rng.normal(size=dims) * rng.choice([0.01, 1, 30])], int(rng.integers(3)) if k % 5 else None) for k in rng.permutation(150)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (400, [0.0] * dims, 2), (401, None, 1), (402, [None] + [0.0] * (dims - 1), 1), (403, [math.inf] * dims, 1), (404, [math.nan] * dims, 1), (None, [0.25] * dims, None)]
    df = spark.createDataFrame([(*r, b"x", "clash") for r in rows], "vec_id long, embedding array<float>, label int, code binary, __label string").repartition(5)
    books, width = codes.fit(df)
    out = codes.with_label_error(codes.with_codes(df, books, width, keep=["vec_id", "label", "code"]), error_col="error")
    assert out.columns == ["vec_id", "label", "code", "_code", "error", "label_error"]
    want, plain = plain_codes(rows)
    assert books.entries.tolist() == [list(map(list, b)) for b in plain]
    got = out.collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, bytes(r._code), r.error) for r in got) == [w[:3] for w in want]
    sums = {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + e
    assert all(r.label_error == sums[r.label] for r in got)


def test_codes_of_few_and_odd_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    empty = spark.createDataFrame([], ddl)
    books, width = codes.fit(empty)
    assert codes.with_label_error(codes.with_codes(empty, books, width)).count() == 0
    three = spark.createDataFrame([(1, [1.0] * 16, 0), (2, [2.0] * 16, 0), (3, [1.0] * 8, 0)], ddl)
    got = {r.vec_id: (r.code, r.error) for r in codes.with_codes(three, *codes.fit(three)).collect()}
    assert got == {1: (bytes(16), 0), 2: (b"\x01" * 16, 0), 3: (None, None)}
    none = spark.createDataFrame([(1, [], 0)], ddl)
    assert [(bytes(r.code), r.error) for r in codes.with_codes(none, *codes.fit(none)).collect()] == [(bytes(16), 0)]
    with pytest.raises(Exception, match="beyond"):
        big = spark.createDataFrame([(1, [1e9] * 16, 0)], ddl)
        codes.with_codes(big, *codes.fit(big)).collect()


def test_bounds_leave_few_entries_to_compare():
    rng = np.random.default_rng(1)
    books = codes.Codebooks.of(rng.integers(-100, 100, (1, 64, 4)))
    own = rng.integers(-120, 120, (500, 4))
    code, far = books.assign(own)
    exact = ((own[:, None] - books.entries[0]) ** 2).sum(2)
    assert (code[:, 0] == exact.argmin(1)).all() and (far[:, 0] == exact.min(1)).all()
