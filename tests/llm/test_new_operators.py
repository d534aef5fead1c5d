"""Operators 11 to 13 against brute force and on odd tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, embeddings, prefix_trie, registry

# ---- 11

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, lang string, source string, value long, rank int, gid string, n string"


def audited(rows, top=200):
    """Part, group and item by item, straight from the definition."""
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {la: sorted(t for t, n in c.items() if n >= 3) for la, c in docs.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    out = {}
    for la, so in groups:
        terms = kept.get(la, [])
        of = lambda s: {t: share(counts[la, s][t], sum(counts[la, s][x] for x in terms), len(terms)) for t in terms}  # noqa: E731, B023
        p, others = of(so), sorted(s for x, s in groups if x == la and s != so)
        pair = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), s.encode(), s) for s in others for q in [of(s)]]
        whole = collections.Counter({t: sum(counts[la, s][t] for x, s in groups if x == la) for t in terms})
        q = {t: share(whole[t], sum(whole.values()), len(terms)) for t in terms}
        term = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if counts[la, so][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            for i, (v, _, item) in enumerate(found):
                out[la, so, part, item] = (-v, i + 1)
    return out


def divergence_rows():
    rng, vocab = random.Random(2), [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopé漢"]
    rows = [(" ".join(rng.choice(vocab[: 20 + 10 * (i % 6)]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "c" * 50])) for i in range(150)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("12 -- 34", "xx", None), ("One ONE one", "yy", "a"), ("\x00A\x7fb", "en", "a")] + [("Tie tie TIE_tie", "zz", s) for s in "abcc"]
    return rows + [("Long" + "x" * 5000 + " " + "word tail " * 200, "en", "a")] * 3 + rows[:5]


def test_source_divergence(spark):
    rows = divergence_rows()
    df = spark.createDataFrame([(i, *r, 1, 2, "g", "n") for i, r in enumerate(rows)], DOC).repartition(5)
    got = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in divergence.audit(df).collect()}
    assert got == audited(rows) and len(got) > 200
    few = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in divergence.audit(df, top=2).collect()}
    assert few == audited(rows, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_are_sent_on_in_bounded_parts(spark, monkeypatch):
    text = "Aa bb,cc\tdd é" * 40
    assert [t for p in divergence.pieces(text.encode(), 50) for t in p] == [t.encode() for t in TERM.findall(text.lower())]
    assert list(divergence.pieces(b"x" * 500 + b" y", 50)) == [[b"x" * 500], [b"y"]]
    monkeypatch.setattr(divergence, "HOLD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a"] * 4), pa.array(["a b a", "c d", "a e f", ""])], ["lang", "source", "text"])
    total = collections.Counter()
    for b in divergence._count([batch]):
        for term, n, docs in zip(*(b.column(c).to_pylist() for c in ("term", "n", "docs"))):
            total[term] += n * 100 + docs
    assert total == {"a": 302, "b": 101, "c": 101, "d": 101, "e": 101, "f": 101}


def test_shares_of_large_counts_are_exact(spark):
    n, total = 7 * 10**15 + 3, 9 * 10**17 + 1
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(12))).first()[0] == 1 + 10**9 * (n + 1) // (total + 12)


# ---- 12


def linked(vectors, cosine=0.9):
    """Links of each vector and the smallest position that it reaches; what can't be compared is alone."""
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for v, g in zip(vectors, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[b for b in range(n) if b != a and good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *(label[b] for b in near[a])]) for a in range(n)]
        if new == label:
            break
        label = new
    return [len(x) for x in near], label


def turned(base, cosine, rng):
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    z = rng.normal(size=base.shape)
    z -= (z * u).sum(1, keepdims=True) * u
    return cosine * u + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim, options", [(48, {}), (48, {"room": 40}), (20, {"room": 60, "k": 2})])
def test_embedding_dedup(spark, dim, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, dim))
    hot = base[:1] + 0.03 * rng.normal(size=(160, dim))
    v = np.concatenate([base, *(turned(base[:100], c, rng) for c in (0.905, 0.93, 0.98)), hot, base[5:6].repeat(50, 0), base[7:9] * 1e150])
    links, label = linked(v.tolist())
    got = {r["vec_id"]: r for r in embeddings.dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4), **options).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= np.array(links)).all() and found.sum() >= 0.98 * sum(links)
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(v))]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(v)))


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at just above 0.9: at least 0.9 of them, against brute force; none below."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 64))
    v = np.concatenate([base, turned(base, 0.9005, rng), turned(base[:50], 0.8995, rng)])
    links, _ = linked(v.tolist())
    got = {r["vec_id"]: r["n_links"] for r in embeddings.dedup(spark.createDataFrame([(i, [float(np.float64(y)) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.95 * sum(links)


def test_odd_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, nan]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (None, [0.0, 3.0]), (11, [-1.0, 0.0]), (12, [1e-300, 0.0]), (13, [5.0]), (14, [7.0]), (15, [-7.0])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, node string")
    out = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"], r["node"]) for r in embeddings.dedup(df).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 1, 3, True), (None, 1, 3, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)], (12, 3, 1, False), (13, 1, 13, True), (14, 1, 13, False), (15, 0, 15, True)]
    assert out == collections.Counter((*w, "x") for w in want)
    assert embeddings.dedup(df.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [0.6, 0.8]), (2, [0.59, 0.81])], "vec_id long, embedding array<float>")
    assert [r["n_links"] for r in embeddings.dedup(floats).collect()] == [1, 1]


def test_rotations_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embeddings.hadamard(x)
    assert np.allclose(y @ y.T, 16 * (x @ x.T)) and np.allclose(embeddings.hadamard(y), 16 * x)
    home, away = embeddings.codes(x / np.linalg.norm(x, axis=1, keepdims=True), 0, 2, 3)
    assert (away != home[:, None]).all() and away.shape == (5, 3)


# ---- 13

TURN = "conv_id long, turn long, role string, text string, depth int, key string"


def brute_nodes(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = tuple(own.get(lead, [])[:h] + v[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in convs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(x[: len(q)] == q and len(x) > len(q) for x in below))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return out


def trie_rows(seed, n, words, longest):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-300, 3000), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(words)))
    return rows + rows[:7] + [(None, 1, "user", "a"), (200, 1, "é漢", None)]


@pytest.mark.parametrize("seed, n, longest, parts", [(1, 60, 4, 1), (2, 90, 9, 5), (3, 40, 30, 7)])
def test_prefix_trie(spark, seed, n, longest, parts):
    rows = trie_rows(seed, n, ["", None, "é漢", "abc"] if seed < 3 else ["a"], longest)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], TURN).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:  # many ranges, so that nodes cross their borders
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(set(got)) and set(got) == brute_nodes(rows)


def test_prefix_trie_of_nothing_and_of_copies(spark):
    empty = spark.createDataFrame([], TURN)
    assert prefix_trie.trie(prefix_trie.rebuilt(empty)).count() == 0 and prefix_trie.trie(prefix_trie.plain(empty)).count() == 0
    df = spark.createDataFrame([(c, t, "user", f"text {t}", 0, "") for c in range(50, 25_050, 100) for t in range(3)], TURN)
    nodes = sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.plain(df)).select("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").collect())
    assert nodes == [(d, 50, 250, int(d < 3), 1, 249 * 6 * (3 - max(d - 1, 0))) for d in range(4)]


# ---- all


@pytest.mark.parametrize("name, tables", [("op11_source_divergence", ["documents"]), ("op13_prefix_trie", ["conversations"])])
def test_query_equals_sql(spark, data, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, data).select(*want.columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


def test_all_are_registered():
    assert {re.match(r"op(\d+)_", k)[1] for k in registry.QUERIES} == {str(i) for i in range(1, 14)}
