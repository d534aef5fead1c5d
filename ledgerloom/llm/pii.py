"""PII by bootstrapped contextual extraction.

Seeds are what the fixed expressions find: email, ip, card, phone, and keys of well-known formats (kind ``secret``).
Every word that looks like an identifier, and every run of digit groups, is a candidate. The two words before and the
two words behind a seed or candidate, lower-cased, are lexical patterns. Patterns next to enough different instances
are counted over all texts, and Spark scores the graph of patterns and instances in rounds: a pattern scores the share
of its occurrences that are trusted instances (at first the seeds; others count for less) and counts once it has ``SUPPORT`` of them; an
instance scores the best of its patterns and is trusted from ``TRUST`` on, wherever it stands. So trusted candidates
bring in the patterns of their other places, whose instances follow in the next round. Candidates next to a pattern
that ends at ``CONFIDENCE`` or above become spans, of the kind of its trusted instances. Spans of the seeds stay.

Which patterns are worth counting is told to the tasks by a bitmap of fixed size; the tables of patterns and
instances are only ever joined and grouped with map-side sums. Spans depend on the text alone, so they are
joined by a hash of the text: equal rows get equal spans. ``digest`` reads ids as whole numbers (others: null).

Null and empty texts: no spans. Offsets are code points, end exclusive. Empty tables give empty results. All
columns pass through ``find`` and ``redact`` (``spans`` of the input is replaced).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import FOLDED, U, chunks, hash_spans, mix, window_hashes
from .store import BROADCAST_ROWS, bounded, materialize, whole_id

KINDS = ("email", "ip", "card", "phone", "secret")
#: Different instances that make a pattern worth counting, rounds of scoring, the scores to trust and to extract, and
#: what an occurrence with a candidate that is not trusted yet counts for.
SUPPORT, ROUNDS, TRUST, CONFIDENCE, UNKNOWN = 5, 4, 0.5, 0.8, 0.4
BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = "\"'`()[]{}<>,.;:!?=*#$%&|"
_IDENTIFIER = re.compile(r"[A-Za-z0-9@._%+/-]{6,64}")
#: fixed values: formats of keys; those of hexadecimal digits need four digits and four letters
_KEY = re.compile(r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2})")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9 ().+/-]*[0-9]\)?")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_IN_NUMBER = _DIGIT.copy()
_IN_NUMBER[list(b"+().-/,;:!?")] = True
_BEHIND = U(0x5851F42D4C957F2D)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """From each ``@`` to both sides, which finds the leftmost matches without trying each start."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            for x in _IP.finditer(m[0]):
                if all(len(p := g.lstrip(".").lstrip("0")) <= 3 and int(p or 0) <= 255 for g in x.groups()):
                    out.append((1, m.start() + x.start(), m.start() + x.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            out.append((3, at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def _contexts(c):
    """Hash of each two neighbouring words of a chunk."""
    h = c.hashes(FOLDED)
    return window_hashes(h, 2) if len(h) > 1 else np.empty(0, np.uint64)


def _is_key(word: str) -> bool:
    return bool(_KEY.fullmatch(word)) and sum(x.isdigit() for x in word) >= 4 and sum(x.isalpha() for x in word) >= 4


def _likely(c) -> list[tuple[int, int]]:
    """(first word, last word) of what may be an identifier: words of six bytes or more with three digits or an @, and
    runs of words made of digits and the signs between them."""
    digits = np.concatenate(([0], np.cumsum(_DIGIT[c.buf])))
    signs = np.concatenate(([0], np.cumsum(_IN_NUMBER[c.buf])))
    ats = np.concatenate(([0], np.cumsum(c.buf == 64)))
    of = lambda x: x[c.ends] - x[c.starts]
    size, n = c.ends - c.starts, of(digits)
    group = (of(signs) == size) & (n > 0)
    group_next = np.zeros(len(size), bool)  # this word and the next form a run, in one document
    if len(size) > 1:
        group_next[:-1] = group[:-1] & group[1:]
        group_next[c.first[1:-1][c.first[1:-1] > 0] - 1] = False
    starts = np.flatnonzero(group_next & ~np.concatenate(([False], group_next[:-1])))
    ends = np.flatnonzero(group_next & ~np.concatenate((group_next[1:], [False]))) + 1
    inside = np.zeros(len(size) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends + 1, -1)
    single = np.flatnonzero((size >= 6) & ((n >= 3) | (of(ats) > 0)) & (np.cumsum(inside)[:-1] == 0))
    return sorted([*zip(starts.tolist(), ends.tolist()), *((i, i) for i in single.tolist())])


_SPOT = "kind:int,left:long,right:long,inst:long,start:long,end:long"
_BASE = f"doc_id long, t long, n_email long, n_ip long, n_card long, n_phone long, base string, spots array<struct<{_SPOT}>>"
_SPOTS = pa.list_(pa.struct([("kind", pa.int32()), *((n.split(":")[0], pa.int64()) for n in _SPOT.split(",")[1:])]))


def _spots(c, i: int, text: str, spans, likely, pairs) -> list[dict]:
    """Seeds and candidates (kind -1) of document ``i`` of a chunk with their patterns (null at the borders of the text)."""
    lo, hi = int(c.first[i]), int(c.first[i + 1])
    plain = int(c.offs[i + 1] - c.offs[i]) == len(text)
    chars = lambda byte: byte if plain else len(c.buf[c.offs[i] : c.offs[i] + byte].tobytes().decode("utf-8", "surrogatepass"))
    bytes_ = lambda at: at if plain else len(text[:at].encode("utf-8", "surrogatepass"))

    def spot(kind, a, e, first, last):
        left = int(pairs[first - 2].view(np.int64)) if first - 2 >= lo else None
        right = int(mix(pairs[last + 1 : last + 2] ^ _BEHIND).view(np.int64)[0]) if last + 2 < hi else None
        return {"kind": kind, "left": left, "right": right, "inst": _hash(text[a:e]), "start": a, "end": e}

    out = []
    for k, a, e in spans:
        first = int(np.searchsorted(c.starts, c.offs[i] + bytes_(a), side="right")) - 1
        last = int(np.searchsorted(c.starts, c.offs[i] + bytes_(e) - 1, side="right")) - 1
        out.append(spot(k, a, e, first, last))
    for first, last in likely:
        a = chars(int(c.starts[first] - c.offs[i]))
        words = text[a : chars(int(c.ends[last] - c.offs[i]))]
        core = words.strip(_EDGE)
        if first == last:
            kind = 4 if _is_key(core) else -1 if _IDENTIFIER.fullmatch(core) else None
        else:
            m = _NUMBER.search(words)
            core = m[0] if m else ""
            kind = -1 if 7 <= sum(x.isdigit() for x in core) <= 19 else None
        if kind is None:
            continue
        a += words.index(core)
        e = a + len(core)
        if all(y <= a or x >= e for _, x, y in spans):
            out.append(spot(kind, a, e, first, last))
    return out


def base(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base spans, seeds and candidates with their patterns. ``docs``: doc_id, t, text."""

    def run(batches):
        for b in batches:
            rows, texts = [], b.column(2)
            for c in chunks(texts):
                pairs, likely = None, _likely(c)
                at = 0
                for i in range(c.hi - c.lo):
                    text = texts[c.lo + i].as_py() or ""
                    spans, mine = base_spans(text), []
                    while at < len(likely) and likely[at][0] < c.first[i + 1]:
                        mine.append(likely[at])
                        at += 1
                    if (spans or mine) and pairs is None:
                        pairs = _contexts(c)
                    n = [0, 0, 0, 0]
                    for k, _, _ in spans:
                        n[k] += 1
                    rows.append((*n, _join(spans), _spots(c, i, text, spans, mine, pairs) if spans or mine else []))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), _SPOTS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(cols, kinds))], ["doc_id", "t", "n_email", "n_ip", "n_card", "n_phone", "base", "spots"])

    return materialize(docs.mapInArrow(run, _BASE))


def occurrences(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(ctx, total): how often the patterns of the bitmap stand before or behind a word, over all texts."""
    told = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = told.value
        known = lambda p: p[((bits[(p & U(BITS - 1)) >> U(6)] >> (p & U(63))) & U(1)).astype(bool)]
        for b in batches:
            found = []
            for c in chunks(b.column(0)):
                pairs = _contexts(c)
                if not len(pairs):
                    continue
                i = np.arange(len(pairs))
                doc = np.searchsorted(c.first, i, side="right") - 1
                inside = i + 1 < c.first[doc + 1]
                found.append(known(pairs[inside & (i + 2 < c.first[doc + 1])]))
                found.append(known(mix(pairs[inside & (i > c.first[doc])] ^ _BEHIND)))
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["ctx", "n"])

    return docs.select("text").mapInArrow(run, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("total"))


def discovered(docs: DataFrame, known: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(t, extra: array of (kind, start, end)) of the texts with spans besides those of ``base_spans``; None if no text has an identifier at all."""
    spots = known.where("size(spots) > 0").select("t", F.explode("spots").alias("s")).select("t", "s.*")
    if not spots.limit(1).count():
        return None
    sides = spots.select("kind", "inst", F.explode(F.array("left", "right")).alias("ctx")).where("ctx IS NOT NULL")
    edges = sides.groupBy("ctx", "inst").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    edges = materialize(edges)
    patterns = materialize(edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("insts")).where(F.col("insts") >= support).select("ctx"))
    secrets = spots.where("kind = 4").select("t", F.struct("kind", "start", "end").alias("x"))
    words = patterns.groupBy(F.expr(f"int((ctx & {BITS - 1}) >> 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(ctx & 63))")).alias("b")).collect()
    if words:
        bitmap = np.zeros(BITS // 64, np.uint64)
        for r in words:
            bitmap[r["w"]] = np.uint64(r["b"] & (1 << 64) - 1)
        graph = materialize(edges.join(patterns.join(occurrences(docs, bitmap), "ctx"), "ctx"))
        trusted = graph.where("kind >= 0").select("inst", F.lit(1.0).alias("s"), F.col("kind").alias("k")).distinct()
        for _ in range(ROUNDS):
            met = graph.join(trusted, "inst", "left")
            score = met.groupBy("ctx").agg(F.count("s").alias("insts"), F.least(F.lit(1.0), F.sum(F.col("n") * F.coalesce("s", F.lit(UNKNOWN))) / F.first("total")).alias("score"), F.max(F.struct((F.col("n") * F.col("s")).alias("w"), (-F.col("k")).alias("k"))).alias("m"))
            score = materialize(score.where(F.col("insts") >= support).select("ctx", "score", (-F.col("m.k")).alias("pattern_kind")))
            best = graph.where("kind < 0").join(score.where(F.col("score") >= TRUST), "ctx").groupBy("inst").agg(F.max(F.struct("score", (-F.col("pattern_kind")).alias("k"))).alias("b"))
            found = best.select("inst", F.col("b.score").alias("s"), (-F.col("b.k")).alias("k"))
            trusted = graph.where("kind >= 0").select("inst", F.lit(1.0).alias("s"), F.col("kind").alias("k")).distinct().unionByName(found)
        sure = score.where(F.col("score") >= confidence).select("ctx", F.col("pattern_kind").alias("k"))
        near = spots.where("kind < 0").select("t", "start", "end", F.explode(F.array("left", "right")).alias("ctx")).join(sure, "ctx")
        secrets = secrets.unionByName(near.select("t", F.struct(F.col("k").cast("int").alias("kind"), "start", "end").alias("x")))
    return materialize(secrets.groupBy("t").agg(F.collect_set("x").alias("extra")))


def _keyed(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(whole_id(), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))


def _with_extra(df: DataFrame, extra: DataFrame | None, key: str = "t") -> DataFrame:
    if extra is None:
        return df.withColumn("__more", F.lit(None).cast("array<struct<kind:int,start:long,end:long>>"))
    extra = extra.select(F.col("t").alias("__t"), F.col("extra").alias("__more"))
    extra = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
    return df.join(extra, df[key] == extra["__t"], "left").drop("__t")


def _all_spans(text: str, extra) -> list[tuple[int, int, int]]:
    return sorted({*base_spans(text), *((x["kind"], x["start"], x["end"]) for x in extra or ())})


def _mapped(docs: DataFrame, redacted: bool) -> DataFrame:
    docs = docs.drop("spans") if not redacted else docs
    keyed = _keyed(docs)
    extra = discovered(keyed, base(keyed))
    full = _with_extra(docs.withColumn("__text_key", F.xxhash64(F.col("text").cast("string"))), extra, "__text_key")
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    full = full.select(*names, F.col("__more"))

    def run(batches):
        for b in batches:
            extra, texts, spans = b.column(b.num_columns - 1).to_pylist(), b.column(text_at).to_pylist(), []
            cols = list(b.columns[:-1])
            for i, text in enumerate(texts):
                s = _all_spans(text, extra[i]) if text else []
                spans.append([{"kind": KINDS[k], "start": a, "end": e} for k, a, e in s])
                if redacted and s:
                    texts[i] = mask(text, s)
            if redacted:
                cols[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    changed = [len(t) if s and t is not None else n for t, s, n in zip(texts, spans, cols[chars_at].to_pylist())]
                    cols[chars_at] = pa.array(changed, cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, names)
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, span)], [*names, "spans"])

    fields = list(docs.schema.fields)
    if not redacted:
        fields.append(T.StructField("spans", T._parse_datatype_string("array<struct<kind:string,start:long,end:long>>")))
    return full.mapInArrow(run, T.StructType(fields))


def mask(text: str, spans) -> str:
    """Each run of overlapping spans becomes the name of its first span's kind, such as ``<EMAIL>``."""
    out, at = [], 0
    for a, e, k in sorted((a, e, k) for k, a, e in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """All rows and columns with ``spans`` (kind, start, end)."""
    return _mapped(docs, redacted=False)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, each span of ``text`` replaced by its kind; ``n_chars``, if there, is counted anew for changed texts."""
    return _mapped(docs, redacted=True)


def digest(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    known = base(keyed)
    order = F.array_sort(F.transform("__more", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    full = _with_extra(known.drop("spots"), discovered(keyed, known))

    def merge(spans: str, extra) -> str:
        have = [(KINDS.index(k), int(a), int(e)) for k, a, e in (x.split(":") for x in spans.split(",") if x)]
        return _join(sorted({*have, *((x["kind"], x["start"], x["end"]) for x in extra)}))

    def run(batches):
        for b in batches:
            spans = [merge(s, x) if x else s for s, x in zip(b.column("base").to_pylist(), b.column("extra").to_pylist())]
            found = [s.count(",") + 1 if s else 0 for s in spans]
            sums = [hashlib.sha256(s.encode()).hexdigest() for s in b.column("base").to_pylist()]
            keep = ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.int64())], [*keep, "base_sha256", "spans", "n_spans"])

    full = full.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", order.alias("extra"))
    return full.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op5_pii(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
