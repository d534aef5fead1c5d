"""Cases in which an operator once did less than its whole job."""

import collections
import random

from ledgerloom.llm import html_text, quality, suffixes, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def drawn(vocab, n, rng):
    return " ".join(rng.choice(vocab) for _ in range(n))


# ---- 1


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    made = ["http://a.com/en/1", "http://x.example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/9", "http://a.org/es/"]
    spark.createDataFrame(list(enumerate(made)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op1_url_filters(spark, str(tmp_path)).collect()}
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got == dict(enumerate(want))


# ---- 6


def test_all_shown_text_is_rendered():
    t = lambda x: html_text.text_of(x)[0]
    assert t("x <math><mi>a</mi><mo>+</mo><mspace/><mn>2</mn><annotation>no</annotation></math> y") == "x a+2 y"
    assert t("<svg><title>no</title><defs/>no<path d='M0'/><text>one</text><text>two <tspan>2</tspan></text><defs><text>no</text></defs></svg>end").split() == ["one", "two", "2end"]
    assert t("pick <select><option>red<option label=blue>b<optgroup label=more><option>green</select> now").split() == ["pick", "red", "blue", "more", "green", "now"]
    assert t("<input value=Ann><input type=submit value='Send it'><input type=hidden value=no><input type=checkbox value=no><input type=password value=no>").split() == ["Ann", "Send", "it"]
    assert t("<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b></p></div>") == "yes"
    assert t("<div style='display:none'>no<b style='visibility:visible'>no</b></div>a<p style='visibility:hidden'>no</p>") == "a"
    assert t("<ul style='visibility:collapse'><li>no<li><i style='visibility:visible'>yes</i></ul>") == "yes"


# ---- 7


def test_passages_with_a_shared_tail(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    some = lambda n: drawn(vocab, n, rng)
    rows = []
    for i in range(20):
        tail = some(30)
        passage = some(20) + " " + tail
        rows += [some(40) + " " + passage + " " + some(40) for _ in range(2)]
        rows += [some(30) + " " + tail + " " + some(30) for _ in range(40)]
    rng.shuffle(rows)
    seen = collections.Counter(tuple(w[j : j + 50]) for t in rows for w in [t.split()] for j in range(len(w) - 49))
    want = {}
    for i, t in enumerate(rows):
        w = t.split()
        want[i] = len({k for j in range(len(w) - 49) if seen[tuple(w[j : j + 50])] > 1 for k in range(j, j + 50)})
    assert sum(n > 0 for n in want.values()) == 40
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOC)
    assert {r["doc_id"]: r["n_repeated"] for r in suffixes.mark(df).collect()} == want


def test_matches_of_every_reach_around_one_core(spark):
    """One core in many texts, of which some agree further on the left, others on the right: no neighbour of one order has them all."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    core = drawn(vocab, 12, rng).split()
    rows = []
    for _ in range(60):
        left, right = rng.randrange(5, 45), rng.randrange(5, 45)
        front, back = drawn(vocab, left, rng).split(), drawn(vocab, right, rng).split()
        for _ in range(rng.choice([1, 2, 2, 3])):
            a, b = rng.randrange(0, left + 1), rng.randrange(0, right + 1)
            rows.append(" ".join([*drawn(vocab, 45 - a, rng).split(), *front[a:], *core, *back[:b], *drawn(vocab, 45 - b, rng).split()]))
    rows += [rows[3]] * 2 + ["a " * 130, "", None]
    rng.shuffle(rows)
    words = [(t or "").split() for t in rows]
    seen = collections.Counter(tuple(w[j : j + 50]) for w in words for j in range(len(w) - 49))
    want = [len({k for j in range(len(w) - 49) if seen[tuple(w[j : j + 50])] > 1 for k in range(j, j + 50)}) for w in words]
    assert sum(0 < n < 100 for n in want) > 10
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["doc_id"]: r["n_repeated"] for r in suffixes.mark(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOC)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [got[i] for i in range(len(rows))] == want


# ---- 9


def test_small_language_has_its_own_reference(spark):
    rng = random.Random(4)
    large, small = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    rows = [(i, drawn(large, 300, rng), "en", "s", 1) for i in range(100)]
    rows += [(1000 + i, drawn(small, 150, rng), "xx", "s", 1) for i in range(20)]
    rows += [(2000, drawn(large, 150, rng), "xx", "s", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(spark.createDataFrame(rows, DOC)).collect()}
    assert all(kept[i] for i, *_ in rows if i != 2000) and not kept[2000]


def test_long_words_and_many_languages_have_references(spark):
    rng = random.Random(6)
    one, other = (["слово" + x * 3 for x in letters] for letters in ("абвгдежзик", "лмнопрстуф"))
    rows = [(i, drawn(one, 200, rng), "ru", "s", 1) for i in range(40)] + [(100, drawn(other, 200, rng), "ru", "s", 1)]
    rows += [(1000 + i, drawn([f"l{i}x{j}" for j in range(20)], 60, rng), f"l{i}", "s", 1) for i in range(1100)]
    out = {r["doc_id"]: r for r in quality.rate(spark.createDataFrame(rows, DOC)).collect()}
    assert all(out[i]["word_distance"] < 0.3 for i in range(40)) and out[100]["word_distance"] > 0.8
    assert all(out[1000 + i]["word_distance"] < 0.01 for i in range(1100))


def test_distances_equal_plain_arithmetic(spark):
    """Both distances and the verdict, counted again word by word and byte by byte."""
    import math

    rng = random.Random(12)
    vocab = {"en": [f"En{i}" for i in range(30)] + ["a,b", "x#1"], "fr": [f"été{i}" for i in range(25)]}
    rows = [(i, drawn(rng.sample(vocab[la], 20), rng.randrange(1, 160), rng), la, "s", 1) for i in range(60) for la in [rng.choice(["en", "fr"])]] + [(100, None, "en", "s", 1), (101, drawn(vocab["fr"], 120, rng), None, "s", 1), (102, "junk " * 120, "en", "s", 1)]
    kind = lambda x: 1 if 97 <= x <= 122 else 2 if 65 <= x <= 90 else 3 if 48 <= x <= 57 else 4 if x >= 0xC0 else 5 if x in b".,;:!?'\"()-" else 6 if x in b"#*$%&|<>" else 7
    shown = lambda t: [kind(x) for x in (t or "").encode() if not 0x80 <= x < 0xC0 and x not in b" \t\n\v\f\r"]
    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}

    def far(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        return math.sqrt(sum(x[k] * math.log2(x[k] / m[k]) for x in (p, q) for k in x if x[k]) / 2)

    refs = {la: (collections.Counter(w for _, t, x, *_ in rows if la in ("", x) for w in (t or "").split()), collections.Counter(c for _, t, x, *_ in rows if la in ("", x) for c in shown(t))) for la in ("en", "fr", "")}
    for r in quality.rate(spark.createDataFrame(rows, DOC)).collect():
        words, n = (r["text"] or "").split(), len((r["text"] or "").split())
        seen, (of_words, of_chars) = collections.Counter(words), refs[r["lang"] or ""]
        top = {w for w, _ in of_words.most_common(64)}
        fold = lambda c: collections.Counter({(w if w in top else "other"): 0 for w in c}) + collections.Counter([w if w in top else "other" for w in c.elements()])  # noqa: E731, B023
        if n < 50:
            assert r["word_distance"] is None and r["char_distance"] is None and not r["kept"]
            continue
        word, char = far(share(fold(seen)), share(fold(of_words))), far(share(collections.Counter(shown(r["text"]))), share(of_chars))
        assert abs(r["word_distance"] - word) < 1e-9 and abs(r["char_distance"] - char) < 1e-9
        limit = quality.WORD_LIMIT + quality.WORD_NOISE * math.sqrt(1 / n + 1 / sum(of_words.values()))
        assert r["kept"] == (not r["base_failed"] and char <= quality.CHAR_LIMIT and word <= limit)
