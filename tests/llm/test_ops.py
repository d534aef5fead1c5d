"""The ten operators against brute force and on odd tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, media, mixing, ngram_join, pieces, pii, quality, substrings, suffixes, urls

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(60)


def edited(text, k, rng=RNG):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


ROWS = [
    (1, BASE, "en", "a", None), (2, BASE, "en", "a", None), (2, BASE, "en", "a", None), (3, edited(BASE, 2), "en", None, 7), (4, edited(BASE, 30), None, "b", 7), (5, None, None, None, None), (6, "", "en", "a", 0), (7, "  \n\t ", "en", "a", 5),
    (8, "One two", "de", "b", 7), (9, "one\tTWO", "de", "b", 7), (None, prose(80), "en", "a", 1), (None, BASE, "en", "a", 1), (10, prose(40) + " " + PASSAGE + " " + prose(50), "en", "c", 1), (11, prose(30) + "\n" + PASSAGE + "\n" + prose(20), "en", "c", 1),
    (12, "é漢字 " * 3 + "tail ▁ mark\r\n", "fr", "c", 1), (13, "x" * 5000 + " " + prose(3000), "en", "a", 1), (14, prose(200), "en", "a", 1),
] + [(100 + i, edited(BASE, i % 7), "en", "a", 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return WORD.findall(t or "")


# ---- 1


def test_url_filters(spark):
    rules = urls.RULES + [("example.com", "/en/", "allow"), ("a.b", "", "block"), ("", "/z", "block"), ("b", "/q/r", "allow"), ("b", "/q", "block")]
    made = [None, "", "no scheme", "http://COM/en/1", "https://x.example.com/en/7?a#b", "http://example.com/en/8", "http://notexample.com/en/9", "http://com./en/", "http://a.b", "http://x.a.b/q/r/s", "ftp://b/q/rs#/en/", "http://b/q", "http://example.net/de/8", "http://net/de", "x://y.org/es/?", "http://é.com/en/é"] + [f"http://h{i % 5}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'de'}/{i}" for i in range(300)]

    def brute(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(urls._LOWER), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and host and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(made)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r, small in ((rules, 10**6), (table, 10**6), (table, 2)):
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.filter_urls(df, r, small_rules=small, ranges=7).collect()}
        assert got == {i: brute(u) for i, u in enumerate(made)}
    assert urls.filter_urls(df.limit(0), table, small_rules=2).count() == 0


# ---- 2


def jaccard_classes(rows):
    sets, ids = [], []
    for i, t, *_ in rows:
        w = words((t or "").translate(urls._LOWER))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        ids.append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for x in range(len(sets)):
        groups[find(x)].append(x)
    least = {g: min((ids[x] for x in m if ids[x] is not None), default=None) for g, m in groups.items()}
    return collections.Counter((ids[x], len(sets[x]), least[find(x)]) for x in range(len(sets)))


def families(seed):
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(6):
        base = prose(rng.randrange(30, 90), rng)
        for _ in range(rng.randrange(2, 25)):
            out.append((n, edited(base, rng.randrange(0, 6), rng), "en", "s", 1))
            n += 1
    common = prose(12, rng)
    out += [(n + i, common + " " + prose(rng.randrange(4, 20), rng), "en", "s", 1) for i in range(30)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [ngram_join.HOT, 3])
def test_jaccard_join(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "USUAL", 4 if hot == 3 else ngram_join.USUAL)
    rows = ROWS if hot != 3 else ROWS + [(1000 + i, *rest) for i, *rest in families(11)]
    df = spark.createDataFrame(rows, DOC)
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.cluster(df).collect())
    assert got == jaccard_classes(rows)
    assert ngram_join.cluster(none).count() == 0


def test_jaccard_keeps_one(spark, docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = jaccard_classes(ROWS)
    classes = {c for _, n, c in want if n}
    empty = sum(v for (_, n, _), v in want.items() if not n)
    assert kept.count() == len(classes) + empty  # a class of null ids only is one of them, too
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0


def test_components_either_way(spark):
    from ledgerloom.llm.components import components, roots

    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    df = spark.createDataFrame(edges, "x long, y long")
    a, b = ({(r["node"], r["label"]) for r in components(df, few).collect()} for few in (0, 10**6))
    assert a == b
    chain = spark.createDataFrame([(i, i + rng.randrange(1, 4)) for i in range(50)], "x long, y long")
    a, b = ({tuple(r) for r in roots(chain, few).collect()} for few in (0, 10**6))
    assert a == b


# ---- 3


def test_mixing(spark, docs, none):
    out = mixing.mix(docs.withColumn("copies", F.lit("clash"))).collect()
    assert len(out) == len(ROWS)
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in out)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    assert all(v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9 for v in by.values())
    again = mixing.mix(docs.repartition(7)).select("doc_id", "text", "taken").collect()
    key = lambda rows: collections.Counter((r["doc_id"], r["text"], r["taken"]) for r in rows)
    assert key(again) == key(out)
    assert mixing.mix(none).count() == 0


def test_mixing_takes_near_the_target(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng.randrange(1, 60), rng), "en", rng.choice("aaab"), 1) for i in range(1200)]
    out = mixing.mix(spark.createDataFrame(rows, DOC), weights=(1, 3), group_rows=20).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] / r["g"] - 1) < 0.02 for r in out)


def test_mixing_equals_sql(spark, data):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{data}/documents.parquet'")
    key = ["doc_id", "size", "source_size", "target", "taken"]
    a = mixing.op3_mixing(spark, data).toPandas()[key].sort_values(key).reset_index(drop=True)
    assert a.equals(db.sql(mixing.OP3_SQL).df()[key].sort_values(key).reset_index(drop=True))


def test_urls_and_substrings_equal_sql(spark, data):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    for f, sql, key in ((urls.op1_url_filters, urls.OP1_SQL, "page_id"), (substrings.op8_substring_dedup, substrings.OP8_SQL, "doc_id")):
        b = db.sql(sql).df().sort_values(key).reset_index(drop=True).fillna("")
        a = f(spark, data).toPandas()[list(b.columns)].sort_values(key).reset_index(drop=True).fillna("")
        assert a.equals(b)


# ---- 4


def test_pieces_round_trip(spark, docs, none):
    a = pieces.decode(pieces.encode(docs.withColumn("pieces", F.lit(1)))).collect()
    assert len(a) == len(ROWS) and all(r["decoded"] == r["text"] and r["n_pieces"] == len(r["pieces"] or []) for r in a)
    b = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(docs.repartition(5)).collect()}
    assert all(b[(r["doc_id"], r["text"])] == r["pieces"] for r in a)
    same = spark.createDataFrame([(i, "international tokenization of everything", "en", "a", 1) for i in (*range(60), 3, None, None)], DOC)
    c = collections.Counter(tuple(r["pieces"]) for r in pieces.encode(same).collect())
    assert len(c) > 3  # another key, another segmentation
    assert pieces.encode(none).count() == 0


def test_pieces_follow_the_lattice():
    """Frequencies of sampled segmentations of a word against the weights of all its segmentations."""
    own = pieces.lattice(pieces.default_model(), 1.0)
    word = b"tokens"

    def every(at):
        if at == len(b" " + word):
            yield ()
        for p, i in own.ids.items():
            if (b" " + word).startswith(p, at):
                for rest in every(at + len(p)):
                    yield (i, *rest)

    import numpy as np
    import pyarrow as pa

    weights = {s: float(np.exp(sum(own.log[i] for i in s))) for s in every(0)}
    total = sum(weights.values())
    ids, bounds = own.encode([word] * 20000, pieces.seeds(pa.array(range(20000))))
    seen = collections.Counter(tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(20000))
    assert set(seen) <= set(weights)
    assert all(abs(seen[s] / 20000 - w / total) < 0.015 for s, w in weights.items())


# ---- 5

_E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C = re.compile(r"[0-9]([\x20-]?[0-9])+")
_P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    out = [("email", m.start(), m.end()) for m in _E.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in _I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in _C.finditer(t):
        d = re.sub("[ -]", "", m[0])
        odd = [int(x) for x in d[::-1]]
        if 13 <= len(d) <= 19 and sum(odd[::2] + [sum(divmod(2 * x, 10)) for x in odd[1::2]]) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _P.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("a1", BASE, "en", "a", 1), ("7", BASE, "en", "a", 1), (None, None, None, None, None)], "doc_id string, text string, lang string, source string, n_chars long").withColumn("stays", F.lit(1))
    assert {r["doc_id"] for r in ngram_join.cluster(df).collect()} == {None, 7}
    assert ngram_join.keep_one(df).count() == 2 and set(ngram_join.keep_one(df).columns) == set(df.columns)
    assert mixing.mix(df).count() == 3 and pieces.encode(df).count() == 3
    assert {r["doc_id"] for r in pii.digest(df).collect()} == {r["doc_id"] for r in substrings.digest(df).collect()} == {None, 7}


def test_pii_grows_from_instance_to_pattern(spark):
    """Local numbers behind a pattern of seeds are trusted; they bring in a pattern that no seed has, and its other instances."""
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choice(VOCAB) for _ in range(6))
    numbers = [f"0171 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}" for _ in range(40)]
    rows = [f"{filler()} his phone number +1 (743) 555-{1000 + i} {filler()}" for i in range(40)]
    rows += [f"{filler()} his phone number {x} {filler()}" for x in numbers[:20]]
    rows += [f"{filler()} reach him under {x}, {filler()}" for x in numbers]
    rows += [f"{filler()} token = \"{rng.getrandbits(160):040x}\" {filler()}" for _ in range(20)] + [f"{filler()} token = \"Zk{rng.getrandbits(60)}x\" {filler()}" for _ in range(10)]
    clean = [f"{filler()} order no {rng.randrange(10**7, 10**8)} {filler()}" for _ in range(60)]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows + clean)], DOC)).collect()}
    got = {i: [(s["kind"], out[i]["text"][s["start"] : s["end"]]) for s in r["spans"]] for i, r in out.items()}
    assert [got[40 + i] for i in range(20)] == [[("phone", x)] for x in numbers[:20]]
    assert [got[60 + i] for i in range(40)] == [[("phone", x)] for x in numbers]
    assert all(k == "secret" for i in range(100, 130) for k, _ in got[i]) and all(len(got[i]) == 1 for i in range(100, 130))
    assert all(not got[130 + i] for i in range(60))


def test_base_spans():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a1@.+- 9(7)%é\n5") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8 001.2.3.256", "a@b@c.d.e x@-.-", "4111 1111-1111 1111", "+1 (743) 555-3824 +12", "@@@" * 50, "9" * 30000, "." * 20000 + "1.1.1", "a" * 30000 + "@"]
    for t in texts:
        assert [(pii.KINDS[k], a, e) for k, a, e in pii.base_spans(t)] == base(t)


def test_pii(spark, docs, none):
    seeds = [(200 + i, f"please {'phone me' if i % 2 else 'write to'} +1 (743) 555-38{i:02d} é john{i}@mail.example.com from 10.0.0.{i}", "en", "a", 1) for i in range(30)]
    hidden = [(500 + i, f"now phone me 743555{i:04d} or not", "en", "a", 1) for i in range(3)]
    clean = [(600 + i, "the number 12345678 stands in a clean text", "en", "a", 1) for i in range(5)]
    df = spark.createDataFrame(ROWS + seeds + hidden + clean, DOC)
    out = {r["doc_id"]: r for r in pii.digest(df).collect()}
    for i, t, *_ in ROWS + seeds + hidden + clean:
        if i is not None and i != 2:
            want = ",".join(f"{k}:{a}:{e}" for k, a, e in base(t or ""))
            assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert [out[500 + i]["spans"] for i in range(3)] == ["phone:13:23"] * 3
    assert all(out[600 + i]["spans"] == "" for i in range(5))
    red = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert red[500]["text"] == "now phone me <PHONE> or not"
    assert red[600]["text"] == clean[0][1]
    assert pii.redact(df).columns == df.columns and pii.redact(none).count() == 0
    assert pii.find(docs.withColumn("t", F.lit("clash")).withColumn("extra", F.lit(1))).count() == len(ROWS)


# ---- 6


def test_html():
    t = html_text.text_of
    assert t(None) == (None, None) and t("") == ("", None)
    assert t("<p>one<p>two <b>x</b>  y<br>z")[0] == "one\n\ntwo x y\nz"
    assert t("<ul><li>a<li>b<ol start=3><li>c</ol></ul>")[0] == "- a\n- b\n  3. c"
    assert t("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>")[0] == "a     bbb\ncccc  d"
    assert t("<title>A &amp; B</title>x<script>if(a<b)</script><p hidden>no</p><p style='display: none'>no</p><!-- no -->")[:2] == ("x", "A & B")
    assert t("<pre> a\n  b</pre>")[0] == " a\n  b"
    assert t("a <b <c> d")[0] and t("<div" * 3)[0] == ""
    assert t("<div>" * 20000 + "deep")[0] == "deep"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (1, "<p>a", "t")], "page_id long, html string, title string")
    assert sorted((r["page_id"], r["rendered"]) for r in html_text.extract(df).collect() if r["rendered"]) == [(1, "a"), (1, "a")]
    assert html_text.extract(df.limit(0)).count() == 0


# ---- 7, 8


def window_hits(rows, w):
    seen = collections.Counter(tuple(x[j : j + w]) for _, t, *_ in rows for x in [words(t)] for j in range(len(x) - w + 1))
    out = []
    for i, t, *_ in rows:
        x = words(t)
        gone = {k for j in range(len(x) - w + 1) if seen[tuple(x[j : j + w])] > 1 for k in range(j, j + w)}
        out.append((i, len(x), len(gone), hashlib.sha256(" ".join(v for k, v in enumerate(x) if k not in gone).encode()).hexdigest()))
    return collections.Counter(out)


def test_substring_dedup(docs, none):
    got = collections.Counter(tuple(r) for r in substrings.digest(docs).collect())
    assert got == window_hits(ROWS, 35)
    full = substrings.dedup(docs.withColumn("kept", F.lit(0))).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in full) == got
    assert substrings.digest(none).count() == 0


def test_suffix_repeats(spark, docs, none):
    out = collections.defaultdict(list)
    for r in suffixes.mark(docs.withColumn("repeats", F.lit("clash"))).collect():
        out[r["doc_id"]].append(r)
    inside = lambda i, a, b: any(s <= a and b <= e for s, e in out[i][0]["repeats"])
    assert inside(10, 40, 100) and inside(11, 30, 90)
    assert sum(e - s for s, e in out[10][0]["repeats"]) <= 64
    assert out[1][0]["repeats"] == [[0, 120]] and out[14][0]["repeats"] == [] and out[5][0]["n_words"] == 0
    assert suffixes.mark(none).count() == 0


# ---- 9


def counts(t):
    w = words(t)
    seen = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    rep = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality(spark, none):
    extra = [(700 + i, "same line\nsame line\n \n \nother | # é\n" * i, "en", "a", 1) for i in range(4)]
    clean = [(800 + i, prose(300), "en", "a", 1) for i in range(150)]
    junk = [(990, " ".join(x.upper() + "!!" for x in prose(300).split()), "en", "a", 1), (991, " ".join(x + "&&&" for x in prose(300).split()), None, "a", 1)]
    rows = ROWS + extra + clean + junk
    out = quality.rate(spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("clash"))).collect()
    want = collections.Counter((i, *counts(t)) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[800 + i] for i in range(150)) and not kept[990] and not kept[991] and not kept[5]
    assert quality.rate(none).count() == 0


def test_divergence():
    import numpy as np

    p, q = np.array([[0.5, 0.5], [1.0, 0.0]]), np.array([0.0, 1.0])
    assert np.allclose(quality.distance(p, q), [np.sqrt(0.31127812445913283), 1.0])


# ---- 10


def test_media(docs, none):
    for r in media.digest(docs).collect():
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0
    by = {r["doc_id"]: r for r in media.digest(docs).collect()}
    raw = media.pad(BASE.encode())
    assert by[1]["payload_sha256"] == hashlib.sha256(raw).hexdigest() and by[1]["tail_crc32"] == zlib.crc32(raw[-16:])
    assert by[6]["payload_bytes"] == 192 and by[1]["feature"] == by[2]["feature"]
    assert media.digest(none).count() == 0


def test_media_files(spark):
    data = media.wrap(media.pad(b"a" * 5000))
    (track,) = media.parse(data)
    assert media.payload(data, track) == media.pad(b"a" * 5000) and track["codec"] == "raw "
    assert [data[a:b] for a, b in track["keyframes"]] == [media.pad(b"a" * 5000)[k : k + 192] for k in range(0, 5184, 16 * 192)]
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:100])), (3, bytearray(b"")), (4, None)], "id int, m binary")
    out = {r["id"]: r["media_info"] for r in media.probe(df, "m").collect()}
    assert [t["n_samples"] for t in out[1]["tracks"]] == [27] and out[2]["error"] and out[3]["error"] == "no track" and out[4] is None


def test_media_of_damaged_and_fragmented_files(spark):
    import struct

    box, full, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
    good = media.wrap(media.pad(b"a" * 500))
    many = good.replace(struct.pack(">II", 192, 3), struct.pack(">II", 192, (1 << 32) - 1))
    zero = good.replace(full(b"stss", u(1, 1)), full(b"stss", u(1, 0)))
    assert many != good != zero
    for bad in (many, zero):
        assert media._info(bad)["error"]
    # two tracks whose samples are in fragments only
    stbl = lambda codec: box(b"stbl", full(b"stsd", u(1), box(codec, bytes(8))), full(b"stts", u(0)), full(b"stsc", u(0)), full(b"stsz", u(0, 0)), full(b"stco", u(0)))
    trak = lambda n, codec: box(b"trak", full(b"tkhd", u(0, 0, n, 0, 0)), box(b"mdia", full(b"mdhd", u(0, 0, 1000, 0)), box(b"minf", stbl(codec))))
    moov = box(b"moov", trak(1, b"avc1"), trak(2, b"mp4a"), box(b"mvex", full(b"trex", u(1, 1, 40, 0, 0x10000)), full(b"trex", u(2, 1, 20, 5, 0))))
    head = box(b"ftyp", b"isom", u(0)) + moov

    def moof(at):
        one = box(b"traf", full(b"tfhd", u(1), flags=0x20000), full(b"trun", u(3, at, 0x2000000, 10, 20, 30), flags=0x205))
        two = box(b"traf", full(b"tfhd", u(2), flags=0x20000), full(b"trun", u(2, at + 60), flags=0x1))
        return box(b"moof", one, two)

    size = len(moof(0))
    data = head + (moof(size + 8) + box(b"mdat", bytes(70))) * 2
    a, b = media._info(data)["tracks"]
    assert (a["codec"], a["n_samples"], a["duration"]) == ("avc1", 6, 0.24) and (b["codec"], b["n_samples"], b["duration"]) == ("mp4a", 4, 0.08)
    first = len(head) + size + 8
    assert [(x["start"], x["end"]) for x in a["keyframes"]] == [(first, first + 10), (first + size + 78, first + size + 88)]
    assert [(x["start"], x["end"]) for x in b["keyframes"]][:2] == [(first + 60, first + 65), (first + 65, first + 70)]
    assert "error" in media._info(data[:-1]) and media._info(data[:-1])["error"]


def test_media_equals_a_plain_reader(spark, docs):
    """The stored form read without the module: first payload byte and sample count from the boxes' fixed places."""
    import struct

    texts = {i: t for i, t, *_ in ROWS if i is not None}
    for r in media.digest(docs).collect():
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        whole = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        data = media.wrap(whole)
        at = data.rindex(b"mdat" + whole[:64]) + 4
        n = struct.unpack(">I", data[data.index(b"stsz") + 12 :][:4])[0]
        keys = ",".join(f"{at + k * 192}-{at + k * 192 + 192}" for k in range(0, n, 16))
        assert data[at:] == whole and n == len(whole) // 192
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["feature"] == f"codec=raw;duration={len(whole) / 8000:.6f};samples={n};keyframes={keys}"


def test_rows_and_columns_that_span():
    t = lambda x: html_text.text_of(x)[0]
    assert t("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert t("<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tr><td>3<td>4</table>") == "x  y  z\n1     2\n3     4"
    assert t("<table><tr><td colspan=2>wide<td>r<tr><td>a<td>b<td>c</table>").split("\n")[1] == "a  b  c"

