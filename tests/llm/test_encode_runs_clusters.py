"""Byte-level BPE, periodic runs and centroid clusters against plain versions, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from itemloom.llm import centroids, periodic, queries, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
ALPHABETS = ("abcdefghij 'lsrevd\n", "aaab", "01 ÄéЖ中😀 \t ", "=-_/+.,!  ", "".join(map(chr, range(32, 127))), " \n\t\r ", "'s'll've're 'm")
ODD = [None, "", " ", "\n\n  x", "it's 'll we'", "　a\u0085b", "a" * 5000, "the " * 3000, "x\x00y", "<|endoftext|>"]


def ranks_of(name=FILES[0]):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def library(tok):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.vocabulary.rank, special_tokens={})


def strings(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABETS[k % len(ALPHABETS)]) for _ in range(rng.randrange(most))) for k in range(n)]


@pytest.fixture(scope="module")
def tok():
    return tokens.Tokenizer(ranks_of(), public_tokenizers.PATTERN)


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


# --- 11: byte-level BPE


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name):
    tok = tokens.Tokenizer(ranks_of(name), public_tokenizers.PATTERN)
    plain = library(tok)
    for t in strings(1, 2000) + [t for t in ODD if t]:
        assert tok.encode(t) == as_bytes(plain.encode_ordinary(t)), t
        assert tok.decode(tok.encode(t)) == t.encode()


def test_long_texts_are_cut_where_nothing_changes(tok, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 7)
    plain = library(tok)
    for t in strings(2, 500, 200):
        assert "".join(tok.stretches(t)) == t
        assert tok.encode(t) == as_bytes(plain.encode_ordinary(t))
        assert tok.decode(tok.encode(t)) == t.encode()


def test_every_prefix_has_one_last_token(tok):
    v = tok.vocabulary
    for t in strings(3, 150, 25):
        data = t.encode()
        piece = tokens.Piece(v, data)
        for k in range(1, len(data) + 1):
            assert v.token[piece.last[k - 1]] == v.merged(data[:k])[-1]
            ends = [r for token, r in v.rank.items() if data[:k].endswith(token)] if k < 4 else []
            start = lambda r: k - len(v.token[r])  # noqa: E731, B023
            assert not ends or [r for r in ends if v.goes((piece.last[start(r) - 1] + 1 if start(r) else 0) << 32 | r)] == [piece.last[k - 1]]


def test_a_vocabulary_whose_ranks_do_not_grow_along_merges():
    import base64

    words = [bytes([b]) for b in range(256)] + [b"abcd", b"ab", b"cd", b"xyz", b"bc", b"dd"]  # no merge leads to xyz, abcd comes before its parts
    raw = b"\n".join(base64.b64encode(w) + b" " + str(k).encode() for k, w in enumerate(words))
    tok = tokens.Tokenizer(raw, r"\s+|\S+")
    plain = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=tok.vocabulary.rank, special_tokens={})
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("abcdxyz ") for _ in range(rng.randrange(14)))
        assert tok.encode(t) == as_bytes(plain.encode_ordinary(t)), t


def test_appends_and_edits_are_exact(tok):
    rng, plain = random.Random(5), library(tok)
    for seed in range(60):
        base = " ".join(strings(seed, 4, 40))
        e = tokens.Encoding(tok)
        for k in range(0, len(base), 3):
            e.append(base[k : k + 3])
            assert e.ids() == plain.encode_ordinary(e.text)
        for _ in range(15):
            a = rng.randrange(len(e.text) + 1)
            b = min(len(e.text), a + rng.randrange(6))
            e.edit(a, b, rng.choice(strings(rng.randrange(99), 3, 8)))
            assert e.ids() == plain.encode_ordinary(e.text)


def test_edits_touch_few_pieces(tok):
    e = tokens.Encoding(tok, "the quick brown fox " * 2000)
    e.edit(20000, 20003, "slow")
    assert e.matched < 8
    e.append("er and more")
    assert e.matched < 8
    assert e.ids() == library(tok).encode_ordinary(e.text)


def test_encoding_tables(spark, tok):
    texts = ODD + strings(6, 40)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, "again", "again"])], "doc_id long, text string, ids string")
    encoded = tokens.encode(docs, ranks_of(), public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    plain = library(tok)
    for r in tokens.decode(encoded, ranks_of(), public_tokenizers.PATTERN).collect():
        assert bytes(r.ids) == as_bytes(plain.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    assert tokens.encode(docs.limit(0), ranks_of(), public_tokenizers.PATTERN).count() == 0


def test_reencoding_a_table(spark, tok):
    docs = spark.createDataFrame([(1, "it is so"), (2, None), (3, "stays")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 2, "that"), (1, 1, 6, 8, "not"), (2, 1, 5, 9, "new"), (9, 1, 0, 0, "lost")], "doc_id long, at int, start int, end int, new string")
    got = {r.doc_id: (r.text, bytes(r.ids)) for r in tokens.reencode(docs, edits, ranks_of(), public_tokenizers.PATTERN).collect()}
    plain = library(tok)
    assert got == {i: (t, as_bytes(plain.encode_ordinary(t))) for i, t in ((1, "that is not"), (2, "new"))}


# --- 12: periodic runs


def plain_runs(w):
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        start = 0
        while start + q < n:
            if w[start] != w[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end + q - start
            stretch = w[start : start + length]
            least = next(p for p in range(1, q + 1) if stretch[p:] == stretch[:-p])
            if length >= max(24, 3 * q) and least == q:
                out.add((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def run_texts():
    rng = random.Random(8)
    out = []
    for k in range(400):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [f"w{rng.randrange(rng.choice([2, 3, 9, 200]))}" for _ in range(rng.randrange(1, 14))]
            parts += (unit * rng.randrange(1, 14))[: rng.randrange(1, 90)] + [f"u{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        out.append(parts if k % 4 else [rng.choice("ab") for _ in range(rng.randrange(200))])
    fib = ["a", "a b".split()[1]]
    for _ in range(9):
        fib.append(fib[-1] + fib[-2])
    return out + [list(fib[-1]), ["x"] * 23, ["x"] * 24, ["x"] * 100, "a b c".split() * 8, ("a b c".split() * 8)[:-1], [f"k{i}" for i in range(9)] * 3, ([f"k{i}" for i in range(9)] * 3)[1:]]


def test_runs_are_those_of_every_lag():
    found = 0
    for w in run_texts():
        ids, words = periodic.numbered(" ".join(w).encode())
        runs = periodic.runs_of(ids)
        assert runs == plain_runs(w), w
        found += len(runs)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodic.collapse(ids, words, runs).decode() == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert found > 100


def test_words_of_long_texts_are_cut_at_spaces(monkeypatch):
    rng = random.Random(9)
    for size in (1, 3, 8):
        monkeypatch.setattr(periodic, "PIECE", size)
        for _ in range(200):
            t = "".join(rng.choice("ab \t\n\x0bé \x1f") for _ in range(rng.randrange(40)))
            ids, words = periodic.numbered(t.encode())
            assert [words[i].decode() for i in ids] == WORD.findall(t)


def test_the_longest_lags_of_a_long_text():
    rng = random.Random(10)
    unit = [f"w{rng.randrange(40)}" for _ in range(30000)]
    ids, _ = periodic.numbered(" ".join(["new"] * 5 + unit * 3 + unit[:7]).encode())
    assert periodic.runs_of(ids) == [(5, 90007, 30000)]


def test_run_query_against_plain_words(spark, tmp_path):
    rows = [(i, " ".join(w)) for i, w in enumerate(run_texts())] + [(900, None), (901, ""), (902, " \n "), (None, "a " * 30), (3, "b " * 40), (None, None)]
    rows += [(1000 + i, " ".join(f"v{k}" for k in range(n))) for i, n in enumerate([1, 2, 30, 200, 1000] * 30)]
    spark.createDataFrame([(i, t, 1, [(0, 0, 0)]) for i, t in rows], "doc_id long, text string, n_words int, runs array<struct<start:int,length:int,period:int>>").write.parquet(f"{tmp_path}/documents.parquet")

    def expected(i, t):
        w = WORD.findall(t or "")
        w = w if i is None else plant(i, w)
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        end = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (i, len(runs), *end, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))

    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert [d for _, d in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(i, t)) for i, t in rows)
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 13: centroid clusters


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    middle = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((away(v, c), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(middle)):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            if own:
                middle[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    total = sum(d for _, _, d in placed)
    return sorted(repr((i, n, d, sum(e for _, m, e in placed if m == n), total, sha[n])) for i, n, d in placed)


def vectors(seed, n, groups=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, 64))
    return [(int(i), [float(np.float32(x)) for x in middle[rng.integers(groups)] + rng.normal(0, 0.2, 64)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")


def test_clusters_are_those_of_all_distances(spark):
    good = vectors(1, 300)
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [None] + [0.5] * 63), (1004, [float("nan")] * 64), (1005, [float("inf")] * 64), (None, [0.25] * 64), (7, [0.125] * 64), (7, [0.125] * 64), (8, [-0.001] * 64)]
    rows = good + odd + good[:20]
    got = centroids.cluster(frame(spark, rows))
    assert dict(got.dtypes)["cluster"] == "int"
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_clusters(rows)


def test_few_equal_or_no_vectors(spark):
    for rows in (vectors(2, 3), [(i, [0.5] * 64) for i in range(60)], [(i, [float(i % 2)] * 64) for i in range(90)]):
        assert sorted(repr(tuple(r)) for r in centroids.cluster(frame(spark, rows)).collect()) == plain_clusters(rows)
    assert centroids.cluster(frame(spark, [(1, None), (2, [1e30] * 64)])).count() == 0
    assert centroids.cluster(frame(spark, vectors(1, 2)).limit(0)).count() == 0


def test_tree_finds_the_nearest_and_the_least_of_ties():
    rng = np.random.default_rng(3)
    for k in (1, 2, 4, 5, 6, 17, 40, 120):
        for spread in (1, 3, 1000, 1 << 27):
            c = rng.integers(-spread, spread + 1, (k, 8 if spread < 9 else 64))
            x = np.concatenate([rng.integers(-spread, spread + 1, (200, c.shape[1])), c])
            d = centroids.squared(x[:, None, :], c[None])
            number, best = centroids.Tree(c).nearest(x)
            assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def test_the_tree_prunes():
    rng = np.random.default_rng(4)
    middle = rng.integers(-20000, 20000, (40, 64))
    x = middle[rng.integers(0, 40, 500)] + rng.integers(-20, 21, (500, 64))
    tree, tried = centroids.Tree(middle), []
    plain = tree._try
    tree._try = lambda x, rows, *a: (tried.append(len(rows)), plain(x, rows, *a))[1]
    tree.nearest(x)
    assert sum(tried) < 0.8 * 40 * 500


def test_cluster_query_has_sql(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from oracle import DATA, connect, oracle_rows, rows_of

    df = queries.QUERIES["op13_centroid_clusters"](spark, DATA)
    columns, expected = oracle_rows(connect(), queries.ORACLE_SQL["op13_centroid_clusters"])
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_token_query_on_the_tables(spark, tok):
    from oracle import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts, plain = {r.doc_id: r.text for r in docs.collect()}, library(tok)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.QUERIES["op11_byte_bpe"](spark, DATA).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert tuple(r)[1:] == (len(ids), sha(as_bytes(ids)), sha(texts[r.doc_id].encode()))
