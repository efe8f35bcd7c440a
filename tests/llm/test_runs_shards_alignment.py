"""Periodic runs, balanced shards and token alignment against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import FOLDER, ODD, SCHEMA, WORD

from murmur.llm import alignment, periodic_runs, queries, secret_scan, sharding, spot_signatures, url_lists


@pytest.fixture(autouse=True)
def few_parts(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_runs(w):
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if (n := i - s + q) >= max(6, 4 * q) and i > s and (s, n) not in seen:
                seen.add((s, n))
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_op11(doc, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 20, 60, 200]), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        got = periodic_runs.runs([np.array(w, dtype=np.int64) for w in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(w) for w in texts]


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(3)
    for k in (1, 2, 4):
        w = rng.integers(0, k, 300)
        w[100:220] = np.tile(w[100:107], 18)[:120]
        s = np.concatenate([[-1], w, [-2]])
        levels = periodic_runs.grammar(s)
        assert len(levels[-1].symbols) == 3 and len(levels) < 60
        x, y = np.array([(i, j) for i in range(1, 301) for j in range(i + 1, 302)]).T
        got = periodic_runs.extensions(levels, x, y)
        for i, j, n in zip(x.tolist()[::7], y.tolist()[::7], got.tolist()[::7], strict=True):
            assert (s[i : i + n] == s[j : j + n]).all() and s[i + n] != s[j + n]


def test_a_text_of_one_word():
    n = 200_000
    (found,) = periodic_runs.runs([np.zeros(n, dtype=np.int64)])
    assert found.tolist() == [[0, n, 1]] and periodic_runs.kept(n, found).sum() == 1


def test_op11_against_plain(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_periodic_runs(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(plain_op11(*d) for d in docs)
    odd = [*ODD, (9, "a b " * 2000 + "c", None, None, 0, "", 0), (10, " \t\n ", None, None, 0, "", 0), (38, "one two three four", None, None, 0, "", 0), (41, None, None, None, 0, "", 0)]
    odd += [(i, "la " * 40 + "end", None, None, 0, "", 0) for i in range(60, 90)]
    got = queries.op11_periodic_runs(spark, write(spark, odd, tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_op11(d, t) for d, t, *_ in odd), key=repr)


def test_collapse_keeps_the_rest(spark):
    rows = [(1, "a b a b a b a b a b", 5), (None, "x\ty  z", 6), (3, None, 7)]
    out = periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, collapsed long"))
    assert out.columns == ["doc_id", "text", "collapsed"]
    assert {tuple(r) for r in out.collect()} == {(1, "a b", 5), (None, "x\ty  z", 6), (3, None, 7)}


def lawful(out, docs, shards=8):
    """Every document once, counts at most one apart, slots without gaps."""
    rows = out.collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return rows


def test_op12_keeps_equal_texts_and_long_lines_together(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = lawful(queries.op12_balanced_shards(spark, "/root/testdata/sf0.01"), docs)
    text, at = dict(docs), collections.defaultdict(set)
    lines = collections.defaultdict(list)
    for r in rows:
        at[text[r.doc_id]].add(r.shard)
        for line in {x.strip() for x in text[r.doc_id].split("\n")}:
            if len(line) >= sharding.LINE:
                lines[line].append(r.shard)
    several = [s for t, s in at.items() if sum(x == t for x in text.values()) > 1]
    assert several and sum(len(s) == 1 for s in several) >= 0.95 * len(several)
    links = [v for v in lines.values() if len(v) > 1]
    assert sum(len(set(v)) == 1 for v in links) >= 0.85 * len(links), len(links)


def test_op12_edges_and_a_hot_text(spark, tmp_path):
    lawful(sharding.shard(spark.createDataFrame(ODD, SCHEMA)), [r[:2] for r in ODD])
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(i, "hot") for i in range(1000)] + [(i % 700, f"text {i // 2}") for i in range(2000)]
    rows = lawful(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), docs)
    hot = {r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot")}
    assert len(hot) == 3  # a third of all rows fills two shards of an eighth and a part of another
    pairs = collections.defaultdict(set)
    for r in rows:
        pairs[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 1 + 8


def test_label_propagation_finds_communities(spark):
    """Sixteen planted groups of 60 texts with most links inside: dealing by hash cuts seven of eight links."""
    rng = random.Random(4)
    docs = [(i, f"text {i}") for i in range(960)]
    links = [(a, b) for _ in range(6000) for a in [rng.randrange(960)] for b in [a // 60 * 60 + rng.randrange(60) if rng.random() < 0.9 else rng.randrange(960)] if a != b]
    md5 = lambda i: bytearray(hashlib.md5(f"text {i}".encode()).digest())
    hubs = spark.createDataFrame([(md5(x), k) for k, pair in enumerate(links) for x in pair], "class binary, hub long")
    rows = lawful(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), hubs=hubs, rounds=12), docs)
    at = {r.doc_id: r.shard for r in rows}
    cut = sum(at[a] != at[b] for a, b in links) / len(links)
    assert cut < 0.6, cut


def test_grants_stay_within_quotas():
    rng = random.Random(5)
    for _ in range(200):
        room = [rng.randrange(50, 100) for _ in range(4)]
        now = [rng.randrange(40, 105) for _ in range(4)]
        asked = {(a, b, k): rng.randrange(1, 12) for a in range(4) for b in range(4) for k in range(3) if a != b and rng.random() < 0.6}
        got = sharding.granted(asked, now, room)
        assert all(0 < v <= 1 for v in got.values())
        after = [now[s] + sum(asked[k] * v * ((k[1] == s) - (k[0] == s)) for k, v in got.items()) for s in range(4)]
        assert all(x <= max(n, r * sharding.SLACK + 1) + 1e-9 for x, n, r in zip(after, now, room, strict=True))


def plain_op13(docs):
    """Rows of op13 by two merged lists of ends, texts encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    size = {i: len(t) for t, i in a.get_vocab().items()}
    held, links = [], []
    for doc, text in docs:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            piece = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(piece) == (" " + text).encode():
                i = j = at_a = at_b = 0
                ga, gb = [], []
                while i < len(x) or j < len(y):
                    if at_a <= at_b and i < len(x):
                        at_a += size[x[i]]
                        ga.append(x[i])
                        i += 1
                    else:
                        at_b += len(piece[j])
                        gb.append(y[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((ga, gb))
                        ga, gb = [], []
        held.append((doc, groups))
        links.append(collections.Counter((p, q) for ps, qs in groups for p in ps for q in qs))
    rows = collections.Counter(pair for k in links for pair in k)
    top = collections.Counter()
    for (p, _), n in rows.items():
        top[p] = max(top[p], n)
    out = []
    for (doc, groups), k in zip(held, links, strict=True):
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(k.values()), sum(n for pair, n in k.items() if rows[pair] == top[pair[0]]), sum(n * rows[pair] for pair, n in k.items()), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def test_op13_against_plain(spark, tmp_path, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_alignment(spark, FOLDER).collect())) == sorted(plain_op13(docs))
    rng = random.Random(2)
    some = ["a", "b", " ", "  ", "\n", "é", "中", "the", "▁", "\t", "1", ".", "　", "\x1c", "\x85", "İ"]
    odd = ["", None, " ", " x", "  x  y ", "x\n y", "<s> <|endoftext|> <unk>", "é" * 50 + " 中文中文 " * 30, "z" * 3000 + "  " * 900, "\x00 \x01", "😀😀 　 x", "ﬁ ½ ™", "\r\n a"]
    odd += ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    rows = [(None if i % 50 == 7 else i // 2, t, None, None, 0, "", 0) for i, t in enumerate(odd)] + list(ODD)
    got = queries.op13_token_alignment(spark, write(spark, rows, tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_op13([r[:2] for r in rows]), key=repr)
    path_a, path_b = public_tokenizers.path(alignment.VOCAB_A), public_tokenizers.path(alignment.VOCAB_B)
    assert alignment.align(spark.createDataFrame([], SCHEMA), path_a, path_b).count() == 0
    whole = {r.doc_id: r for r in alignment.groups(spark.createDataFrame([(1, "hello <s> world"), (2, "▁"), (3, None)], "doc_id long, text string"), path_a, path_b).collect()}
    assert sum(g.a for g in whole[1].groups) == len(whole[1].a) and sum(g.b for g in whole[1].groups) == len(whole[1].b)
    assert whole[2].groups == [] and whole[3].a == []


def test_links_of_large_groups(monkeypatch):
    both = alignment.Tokenizers(public_tokenizers.path(alignment.VOCAB_A), public_tokenizers.path(alignment.VOCAB_B))
    texts = ["the words are thorattly done", "Ωμέγα " * 20, "ab" * 50]
    want = [x.tolist() for x in alignment.Chunk(texts, both).links()]
    monkeypatch.setattr(alignment, "WRITTEN", 1)
    assert [x.tolist() for x in alignment.Chunk(texts, both).links()] == want


def test_diagonals():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.choice(n, rng.integers(0, n), replace=False) + 1, n)) for _ in range(2))
        got = alignment.grouped(a, b)
        shared = np.intersect1d(a, b)
        want = [np.diff(np.concatenate([[0], np.searchsorted(x, shared) + 1])) for x in (a, b)]
        assert [g.tolist() for g in got] == [w.tolist() for w in want]
    assert [len(x) for x in alignment.grouped(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0]


def test_tables_left_behind(spark):
    """Nothing but the result stays in the shared folder."""
    import os

    from murmur.sources.storage import shared_root

    root = shared_root(spark).removeprefix("file:")
    docs = spark.createDataFrame(ODD, SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.b.org/c", "")], "page_id long, url string, html string")
    builds = {
        "shards": lambda: sharding.shard(docs),
        "alignment": lambda: alignment.align(docs, public_tokenizers.path(alignment.VOCAB_A), public_tokenizers.path(alignment.VOCAB_B)),
        "secret-spans": lambda: secret_scan.scan(docs),
        "judged-captures": lambda: url_lists.evaluate(url_lists.dated_captures(pages), url_lists.dated_entries(pages)),
        "spot-links": lambda: spot_signatures.linked(docs),
    }
    for name, build in builds.items():
        before = set(os.listdir(root)) if os.path.isdir(root) else set()
        build()
        assert [x.rpartition("-")[0] for x in set(os.listdir(root)) - before] == [name]

