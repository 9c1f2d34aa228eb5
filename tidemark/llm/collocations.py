"""Phrase collocation mining by stripes.

A *stripe* is the associative counter of the words that follow one prefix. Tasks fill stripes for what they read, and
stripes of one prefix are merged elementwise.

1. *Empty prefix.* The stripe of no words counts the words of each language. It gives the total n, the words that occur
   often enough to be in a candidate, and an id for each word: 63 bits of a hash, told apart exactly, for words whose
   bits are the same get negative ids of their own.
2. *Prefixes of two words.* Words too rare for a candidate end a piece, for no candidate holds them. Each place of two
   words adds one to the stripe of that prefix at the word that follows, or at "none". A stripe's total is the count of
   its prefix, its entries are the counts of the phrases of three words, and its largest entry is the longest phrase
   that may subsume the prefix from the right. Entries regrouped by their last two words give the same from the left.
3. *Merge.* Tasks emit a stripe as one row, prefixes are dealt by hash and sorted, and a task merges runs of rows of one
   prefix; it holds the merged stripe of one prefix and one batch. Only prefixes of two very frequent words have stripes
   without a bound, so these are cut into ``shards`` by the next word. A word is very frequent if it makes up a 1024th
   of all words, so there are at most 1024 of these, and they are sent to all tasks.

The other thing sent to all tasks is a bit map of the ids of frequent words, at most ``most_bits`` bits. More words than
it can tell apart only let more rare words through, whose stripes never reach the least count.

Defined results: a null text has no words; a null language is ``und``, together with rows that say so. Repeated rows count
again. An empty table gives no rows. Null ids do not matter: no id is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARES = 1024
WORDS = "lang string, word binary, id long, n long"
STRIPES = "a long, b long, shard int, nexts array<long>, counts array<long>"
MERGED = "a long, b long, total long, nexts array<long>, counts array<long>"

#: Separators of pieces become a line feed, tabs a space; A-Z become lower case. All other bytes stay.
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
_BREAK = b"\n"


def tokens(text: str, chunk: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words in order, a line feed for each end of a piece, and empty strings where spaces follow each other; a long text
    comes in lists of about ``chunk`` bytes, cut at spaces."""
    plain, at = text.encode().translate(_PLAIN).replace(b"\n", b" \n "), 0
    while at < len(plain):
        end = plain.find(b" ", at + chunk)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split(b" ")
        at = end + 1


def word_id(lang: str, word: bytes, bits: int = 63) -> int:
    """Never 0, which is no word."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode())) >> (64 - bits) or 1


class _Places(dict):
    """word -> place in order of first sight; 0 is a break, 1 is nothing."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        yield lang.as_py(), text.as_py()


def _blocks(batches: Iterator[pa.RecordBatch], most_tokens: int, most_words: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words by place, places of all tokens): what a task has read of one language, in blocks."""
    open_blocks: dict[str, tuple[_Places, list[np.ndarray]]] = {}
    held = 0

    def closed() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        while open_blocks:
            lang, (places, parts) = open_blocks.popitem()
            yield lang, list(places), np.concatenate(parts)

    words = 0
    for batch in batches:
        for lang, text in _texts(batch):
            if lang not in open_blocks:
                open_blocks[lang] = (_Places(), [])
            places, parts = open_blocks[lang]
            before = len(places)
            for found in tokens(text):
                at = np.fromiter(map(places.__getitem__, found), dtype=np.int32, count=len(found))
                parts.append(at[at != 1])
                held += len(parts[-1])
            parts.append(np.zeros(1, dtype=np.int32))
            held, words = held + 1, words + len(places) - before
            if held >= most_tokens or words >= most_words:
                yield from closed()
                held = words = 0
    yield from closed()


def count_words(docs: DataFrame, bits: int = 63, most_tokens: int = 4_000_000, most_words: int = 500_000) -> DataFrame:
    """docs: lang, text. The stripe of the empty prefix: lang, word (bytes), id, n."""

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, at in _blocks(batches, most_tokens, most_words):
            n = np.bincount(at, minlength=len(words))[2:]
            words = words[2:]
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([word_id(lang, w, bits) for w in part], pa.int64()), pa.array(n[i : i + 50_000], pa.int64())], names=["lang", "word", "id", "n"])

    return docs.mapInArrow(stripes, WORDS).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def told_apart(words: DataFrame, most: int = 100_000) -> dict[tuple[str, bytes], int]:
    """Words that share an id, each with a negative id of its own. Of V words, about V * V / 2**64 are expected; more
    than ``most`` would mean that the ids are too short, which is an error."""
    shared = words.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    rows = words.join(shared, "id", "left_semi").select("lang", "word").limit(most + 1).collect()
    if len(rows) > most:
        raise RuntimeError("too many words share an id")
    return {(lang, word): -1 - i for i, (lang, word) in enumerate(sorted((r["lang"], bytes(r["word"])) for r in rows))}


def _bit_map(ids: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for each id, by its last bits; as many as hold the ids sparsely, up to ``most_bits``."""
    bits = min(most_bits, 1 << max(16, (16 * ids.count()).bit_length()))
    word = F.pmod("id", F.lit(bits))
    got = ids.groupBy(F.shiftright(word, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(id, {bits}L) % 64 as int))")).alias("set")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["at"].to_numpy(dtype=np.int64)] = got["set"].to_numpy(dtype=np.int64)
    return out


def emit_stripes(docs: DataFrame, frequent: np.ndarray, very: np.ndarray, own: dict[tuple[str, bytes], int], bits: int = 63, shards: int = 64, most_tokens: int = 4_000_000, most_words: int = 500_000) -> DataFrame:
    """docs: lang, text. frequent: bit map of ids. very: sorted ids. own: words with ids of their own. Stripes of
    prefixes of two words as tasks have filled them; a next word 0 is none."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, very, own))

    def ids_of(lang: str, words: list[bytes], frequent: np.ndarray, own: dict) -> np.ndarray:
        ids = np.fromiter((word_id(lang, w, bits) for w in words), dtype=np.int64, count=len(words))
        if own:
            ids = np.fromiter((own.get((lang, w), i) for w, i in zip(words, ids.tolist(), strict=True)), dtype=np.int64, count=len(words))
        low = ids & (len(frequent) * 64 - 1)
        ids[(frequent[low >> 6] >> (low & 63)) & 1 == 0] = 0
        return ids

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, very, own = shared.value
        for lang, words, at in _blocks(batches, most_tokens, most_words):
            # Frequent words of this block by small numbers, so that three of them fit one long.
            ids = ids_of(lang, words, frequent, own)
            ids[:2] = 0
            known = np.unique(np.r_[np.zeros(1, dtype=np.int64), ids])
            zero = np.searchsorted(known, 0)
            small = np.searchsorted(known, ids).astype(np.int32)
            hot = np.isin(known, very)
            x = np.r_[small[at], np.full(2, zero, dtype=np.int32)]
            there = (x[:-2] != zero) & (x[1:-1] != zero)
            a, b, c, n = _counted(x[:-2][there], x[1:-1][there], x[2:][there], len(known))
            nexts = known[c]
            shard = np.where(hot[a] & hot[b], (nexts & (shards - 1)) + 1, 0).astype(np.int32)
            if shard.any():
                by = np.lexsort((shard, b, a))
                a, b, nexts, shard, n = a[by], b[by], nexts[by], shard[by], n[by]
            yield from _rows([known[a], known[b], shard], nexts, n)

    return docs.mapInArrow(stripes, STRIPES)


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, below: int) -> tuple[np.ndarray, ...]:
    """The combinations of three numbers in order, and how often each is there."""
    width = below.bit_length()
    if 3 * width <= 63:
        keys = a.astype(np.int64)
        for x in (b, c):
            keys <<= width
            keys |= x
        keys.sort()
        at = _starts(keys)
        n, keys, low = np.diff(np.r_[at, len(keys)]), keys[at], (1 << width) - 1
        return keys >> (2 * width), (keys >> width) & low, keys & low, n
    by = np.lexsort((c, b, a))
    a, b, c = a[by], b[by], c[by]
    at = _starts(a, b, c)
    return a[at], b[at], c[at], np.diff(np.r_[at, len(a)])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are in order."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    changed = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(changed) + 1]


def _rows(keys: list[np.ndarray], nexts: np.ndarray, counts: np.ndarray, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Entries in order of their keys as stripes, a row for each key."""
    starts = np.r_[_starts(*keys), len(nexts)]
    for i in range(0, len(starts) - 1, size):
        s = starts[i : i + size + 1]
        heads, offsets = s[:-1], pa.array(s - s[0], pa.int32())
        body = slice(s[0], s[-1])
        columns = [pa.array(k[heads]) for k in keys] + [pa.ListArray.from_arrays(offsets, pa.array(v[body].astype(np.int64))) for v in (nexts, counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shard", "nexts", "counts"])


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """a, b, total, nexts, counts: stripes of one prefix (and shard) added up elementwise. Entries below ``least`` go
    after they are in the total, as do whole stripes below it, if they are not shards."""
    dealt = stripes.repartition("a", "b", "shard").sortWithinPartitions("a", "b", "shard")

    def added(a: np.ndarray, b: np.ndarray, s: np.ndarray, nexts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        by = np.lexsort((nexts, s, b, a))
        a, b, s, nexts = a[by], b[by], s[by], nexts[by]
        at = _starts(a, b, s, nexts)
        return [a[at], b[at], s[at], nexts[at], np.add.reduceat(n[by], at) if len(at) else n]

    def finished(a: np.ndarray, b: np.ndarray, s: np.ndarray, nexts: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = _starts(a, b, s)
        if not len(at):
            return
        total = np.add.reduceat(n, at)
        keep = (total >= least) | (s[at] > 0)
        strong = (n >= least) & (nexts != 0)
        before = np.r_[0, np.cumsum(strong)]
        ends = np.r_[at[1:], len(n)]
        sizes = (before[ends] - before[at])[keep]
        own = strong & np.repeat(keep, ends - at)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[own].astype(np.int64))) for v in (nexts, n)]
        yield pa.RecordBatch.from_arrays([pa.array(a[at][keep]), pa.array(b[at][keep]), pa.array(total[keep], pa.int64()), *lists], names=["a", "b", "total", "nexts", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lengths = np.diff(batch.column("nexts").offsets.to_numpy())
            keys = [np.repeat(batch.column(c).to_numpy(), lengths) for c in ("a", "b", "shard")]
            new = [*keys, batch.column("nexts").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()]
            if not len(new[0]):
                continue
            # Rows come in order, so all but the last prefix of what is held are whole.
            held = added(*new) if held is None else added(*[np.r_[x, y] for x, y in zip(held, new, strict=True)])
            last = _starts(*held[:3])[-1]
            yield from finished(*[x[:last] for x in held])
            held = [x[last:] for x in held]
        if held is not None:
            yield from finished(*held)

    return dealt.mapInArrow(merge, MERGED)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, subsumed_percent: int = 50, most: int = 2000, bits: int = 63, most_bits: int = 1 << 27, shards: int = 64, **blocks: int) -> DataFrame:
    """Each language's first ``most`` phrases of two or three words: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    words = stored(count_words(docs, bits, **blocks), "words")
    own = told_apart(words)
    if own:
        apart = words.sparkSession.createDataFrame([(lang, bytearray(word), i) for (lang, word), i in own.items()], "lang string, word binary, other long")
        words = stored(words.join(F.broadcast(apart), ["lang", "word"], "left").withColumn("id", F.coalesce("other", "id")).drop("other"), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total_n"))
    frequent = words.where(F.col("n") >= least)
    share = words.agg(F.sum("n")).first()[0] or 0
    very = np.sort(np.array([r["id"] for r in frequent.where(F.col("n") * SHARES >= share).select("id").collect()], dtype=np.int64))

    stripes = stored(merge_stripes(emit_stripes(docs, _bit_map(frequent.select("id"), most_bits), very, own, bits, shards, **blocks), least), "stripes")
    two = stripes.groupBy("a", "b").agg(F.sum("total").alias("f"), F.max(F.coalesce(F.array_max("counts"), F.lit(0))).alias("right")).where(F.col("f") >= least)
    three = stripes.select("a", "b", F.explode(F.arrays_zip(F.col("nexts").alias("c"), F.col("counts").alias("f"))).alias("e")).select("a", "b", "e.c", "e.f")

    named = frequent.select("id", "lang", F.col("word").cast("string").alias("word"), "n")

    def word(at: str) -> DataFrame:
        return named.select(F.col("id").alias(at), F.col("word").alias(f"{at}_word"), F.col("n").alias(f"{at}_n"), *([F.col("lang")] if at == "a" else []))

    from_left = three.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("f").alias("left"))
    longest = F.greatest("right", F.coalesce("left", F.lit(0)))
    pairs = two.join(from_left, ["a", "b"], "left").where(F.lit(100) * longest < F.lit(subsumed_percent) * F.col("f"))
    pairs = pairs.join(word("a"), "a").join(word("b"), "b")
    pairs = pairs.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("f").alias("a"), F.array(F.struct(F.col("a_n").alias("l"), F.col("b_n").alias("r"), F.lit(1).alias("k"))).alias("cuts"))

    head, tail = two.select("a", "b", F.col("f").alias("head")), two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("tail"))
    triples = three.join(head, ["a", "b"]).join(tail, ["b", "c"]).join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
    cuts = F.array(F.struct(F.col("a_n").alias("l"), F.col("tail").alias("r"), F.lit(1).alias("k")), F.struct(F.col("head").alias("l"), F.col("c_n").alias("r"), F.lit(2).alias("k")))
    triples = triples.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("f").alias("a"), cuts.alias("cuts"))

    # Exact in decimals of 38 digits, for counts below 10 ** 15.
    score = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(c.l as decimal(15,0)) * cast(c.r as decimal(15,0)))"
    best = F.expr(f"array_min(transform(cuts, c -> struct({score} as score, c.k as k, c.l as l, c.r as r)))")
    scored = pairs.unionByName(triples).withColumn("cut", best).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return top(scored, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total_n").alias("n"), "score")


def top(scored: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """The first of each language by score, a and phrase. They are first found in ``salts`` parts of a language, so
    that the task that ranks a language gets at most ``salts * most`` rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    t = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= most)
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return t.where(F.col("rank") <= most).drop("_salt")


#: By definition, with every phrase as a row.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents WHERE text IS NOT NULL),
q AS (SELECT lang, list_filter(string_split_regex(s, '[ \t]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM i GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM i WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM i WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT lang, x, y, max(f) AS m FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, [{'k': 1, 'l': u.f, 'r': v.f}] AS cuts
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
  LEFT JOIN s ON s.lang = f2.lang AND s.x = f2.x AND s.y = f2.y WHERE 100 * coalesce(s.m, 0) < 50 * f2.f
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, [{'k': 1, 'l': u.f, 'r': t.f}, {'k': 2, 'l': h.f, 'r': v.f}]
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z
  JOIN f2 h ON h.lang = f3.lang AND h.x = f3.x AND h.y = f3.y JOIN f2 t ON t.lang = f3.lang AND t.x = f3.y AND t.y = f3.z),
d AS (SELECT lang, phrase, a, unnest(cuts, recursive := true) FROM c),
e AS (SELECT *, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS score FROM d),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000"""
