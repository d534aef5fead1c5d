"""Quality rules: distribution divergence against language references, with minimum-length guards.

Two histograms of a document are compared with the reference of its language by Jensen-Shannon distance
(base 2, so between 0 and 1): character classes, and the ``K`` most common words of the language plus
one bin for all other words. The references are counted over all documents. A document is rejected if
either distance exceeds its limit, and each test applies only from a minimum length on, since the distance of
a short text from any reference is mostly noise. Base rules: fewer than ``MIN_WORDS`` words, or more than
half of the words in repeated 3-word windows.

Null and empty texts: all counts 0, ``base_failed``. A language has its own reference however few its words are;
the word limit rises by the sampling noise of the reference as it does by the document's. A null or empty ``lang``
is compared with the reference of all documents together; a language without a reference is not tested for
divergence. Repeated rows get equal results; an empty table gives an empty result; other columns pass through ``rate`` (names of its results are
replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import SEP, U, chunks, inside, mix, window_hashes
from .store import bounded, materialize

MIN_WORDS, K = 50, 64
#: Limits of the distances, and the least words from which each test applies. The distance of n sampled words from
#: their own source falls as 1 / sqrt(n), so the limit of the word test is WORD_LIMIT + WORD_NOISE * sqrt(1 / n + 1 / r), where
#: r is the number of words in the reference.
CHAR_LIMIT, CHAR_WORDS, WORD_LIMIT, WORD_NOISE, WORD_WORDS = 0.34, 50, 0.29, 1.2, 50

_SYMBOLS = b"#*$%&|<>"
_CLASSES = 8


def _classes() -> np.ndarray:
    """Byte -> class: 0 none (continuation bytes, white space), lower, upper, digit, other letters, sentence marks, symbols, other signs."""
    t = np.full(256, 7, np.int64)
    t[SEP] = 0
    t[0x80:0xC0] = 0
    t[0xC0:] = 4
    t[97:123], t[65:91], t[48:58] = 1, 2, 3
    t[list(b".,;:!?'\"()-")] = 5
    t[list(_SYMBOLS)] = 6
    return t


CLASS = _classes()
SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
_START = (np.arange(256) & 0xC0) != 0x80


def class_counts(chunk) -> np.ndarray:
    cls = CLASS[chunk.buf]
    out = np.empty((chunk.hi - chunk.lo, _CLASSES), np.int64)
    for k in range(len(out)):
        out[k] = np.bincount(cls[chunk.offs[k] : chunk.offs[k + 1]], minlength=_CLASSES)
    out[:, 0] = 0
    return out


def references(docs: DataFrame, k: int = K) -> tuple[dict, dict]:
    """{lang: class histogram} and {lang: (sorted word hashes, histogram with the other words last, words)}; '' is all documents."""

    def count(batches):
        def flush(words, classes):
            rows = [(lang, 0, c, int(n)) for lang, v in classes.items() for c, n in enumerate(v) if n]
            for lang, (parts_h, parts_n) in words.items():
                h, inv = np.unique(np.concatenate(parts_h), return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate(parts_n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names)
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names)

        names, words, classes, held = ["lang", "kind", "key", "n"], {}, {}, 0
        for b in batches:
            langs = np.array([x if x is not None else "" for x in b.column(0).to_pylist()], object)
            for c in chunks(b.column(1)):
                h, per = c.hashes(), class_counts(c)
                own = langs[c.lo : c.hi]
                counts = c.counts()
                for lang in set(own.tolist()):
                    pick = own == lang
                    classes[lang] = classes.get(lang, 0) + per[pick].sum(0)
                    of = np.repeat(pick, counts)
                    hs, n = np.unique(h[of], return_counts=True)
                    slot = words.setdefault(lang, ([], []))
                    slot[0].append(hs)
                    slot[1].append(n)
                    held += len(hs)
                if held > 500_000:  # a bound on memory: what is held is added up in Spark
                    yield from flush(words, classes)
                    words, classes, held = {}, {}, 0
        yield from flush(words, classes)

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, kind int, key long, n long")
    sums = materialize(rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    spread = sums.unionByName(sums.where("lang != ''").withColumn("lang", F.lit(""))).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    top = spread.where("kind = 1").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= k)
    chars, words = {}, {}
    for r in spread.where("kind = 0").groupBy("lang").agg(F.collect_list(F.struct("key", "n")).alias("v")).collect():
        v = np.zeros(_CLASSES)
        for x in r["v"]:
            v[x["key"]] = x["n"]
        chars[r["lang"]] = v / max(1, v.sum())
    whole = {r["lang"]: r["n"] for r in spread.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for r in top.groupBy("lang").agg(F.collect_list(F.struct("key", "n")).alias("v")).collect():
        keys = np.array([x["key"] for x in r["v"]], np.int64).view(np.uint64)
        n = np.array([x["n"] for x in r["v"]], float)
        order = np.argsort(keys)
        words[r["lang"]] = (keys[order], np.append(n[order], whole[r["lang"]] - n.sum()) / whole[r["lang"]], whole[r["lang"]])
    return chars, words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def _duplicate_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeat_words(c, h: np.ndarray) -> np.ndarray:
    """For each document, the words that lie in 3-word windows which it has twice or more."""
    at = inside(c, 3)
    if not len(at):
        return np.zeros(c.hi - c.lo, np.int64)
    doc = c.doc_of_word()
    w = mix(window_hashes(h, 3)[at] ^ mix(doc[at].astype(np.uint64) + U(1)))
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    hit = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(h) + 3, bool)
    for k in range(3):
        cover[hit + k] = True
    return np.bincount(doc[cover[: len(h)]], minlength=c.hi - c.lo)


RESULT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("char_distance", "double"), ("word_distance", "double"), ("kept", "boolean")]


def rate(docs: DataFrame, keep: list[str] | None = None, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Adds the counts, both distances (null below their minimum length) and ``kept`` to every row; ``keep``: columns that stay (default all)."""
    spark = docs.sparkSession
    chars, words = references(bounded(docs))
    refs = spark.sparkContext.broadcast((chars, words))
    keep = [c for c in docs.columns if c not in dict(RESULT)] if keep is None else keep
    body = docs.select(*keep, F.col("lang").cast("string").alias("__lang"), F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in RESULT)).fields])

    def run(batches):
        chars_, words_ = refs.value
        for b in batches:
            langs = [x or "" for x in b.column(b.num_columns - 2).to_pylist()]
            texts = b.column(b.num_columns - 1)
            out = {name: [] for name, _ in RESULT}
            for c in chunks(texts):
                h, n = c.hashes(), c.counts()
                repeat = _repeat_words(c, h)
                per = class_counts(c)
                own = np.array(langs[c.lo : c.hi], object)
                cd, wd, of_ref = np.full(len(n), np.nan), np.full(len(n), np.nan), np.ones(len(n))
                doc = c.doc_of_word()
                for lang in set(own.tolist()):
                    if lang not in words_:  # no reference
                        continue
                    pick = np.flatnonzero(own == lang)
                    keys, ref, of_ref[pick] = words_[lang]
                    of = np.isin(doc, pick)
                    i = np.searchsorted(keys, h[of])
                    i[i == len(keys)] = 0
                    bin_ = np.where(keys[i] == h[of], i, len(keys))
                    hist = np.bincount(doc[of] * (len(keys) + 1) + bin_, minlength=len(n) * (len(keys) + 1)).reshape(len(n), -1)[pick]
                    wd[pick] = distance(hist / np.maximum(1, hist.sum(1, keepdims=True)), ref)
                    p = per[pick]
                    cd[pick] = distance(p / np.maximum(1, p.sum(1, keepdims=True)), chars_[lang])
                cd[n < CHAR_WORDS] = np.nan
                wd[n < WORD_WORDS] = np.nan
                failed = (n < MIN_WORDS) | (100 * repeat > 50 * n)
                out["n_words"].append(n)
                out["word_chars"].append(c.total(_START[c.buf] & ~SEP[c.buf]))
                out["n_symbols"].append(c.total(SYMBOL[c.buf]))
                out["n_dup_lines"].append(np.array([_duplicate_lines(texts[k].as_py()) for k in range(c.lo, c.hi)], np.int64))
                out["n_repeat_words"].append(repeat)
                out["base_failed"].append(failed)
                out["char_distance"].append(cd)
                out["word_distance"].append(wd)
                out["kept"].append(~failed & ~(cd > char_limit) & ~(wd > word_limit + WORD_NOISE * np.sqrt(1 / np.maximum(1, n) + 1 / of_ref)))
            cols = []
            for name, kind in RESULT:
                v = np.concatenate(out[name]) if out[name] else np.empty(0)
                arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind]
                cols.append(pa.array(v, arrow, mask=np.isnan(v) if kind == "double" else None) if len(v) else pa.array([], arrow))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], [*keep, *dict(RESULT)])

    return body.mapInArrow(run, schema)


def op9_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return rate(docs, keep=["doc_id"])
