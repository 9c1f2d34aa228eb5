"""Personal data by base patterns and bootstrapped contextual extraction.

One pass over the whole texts finds the base spans (email, ip, card, phone), keys of well-known forms that are given to
a name such as "token", and candidates:
every other token or group of numbers that holds a digit or an at sign, whatever its form. Each comes with its lexical
patterns: the word before it, the two words before it, and the words on both sides. Base spans and keys are the
seeds. Spark then scores the graph of patterns and instances in turns, until nothing new is found:

- A pattern's score for a kind is the scored share of that kind among its instances, damped for few. It is confident
  if that share is high and enough of its instances are known. Kinds are each other's counter-examples; candidates
  that nothing is known of weigh ``unknown`` of one each; repeated copies count once.
- An instance's score is one minus the product of the doubts of its confident patterns. An instance that becomes sure
  is known in the next turn and so induces patterns that no seed stands with.

In the end, confident patterns turn the candidates that they stand with into spans, and the keys into spans of the
kind "secret".

Defined results: a null or empty text has no spans. Rows that share id and text have the same spans and one result
each. Places are code points, ends exclusive. Base spans of different kinds may overlap and all stay; found ones
overlap no base span. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, parted, stored

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
UNKNOWN = -1  # rank of a candidate
#: Fixed values of the contract, in forms that need no second look at a character (runs are taken whole).
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Forms of keys and names they are given to; together the seeds of the kind "secret".
NAMED = re.compile(r"(?:token|key|secret|passw(?:or)?d|passwd|pwd|credentials?)[\"']?\s?[:=]\s?[\"']?$", re.IGNORECASE)
KEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,80})(?![0-9A-Za-z])")
#: What makes a token a candidate, what it may hold, and what joins groups of numbers.
MARK = re.compile(r"[0-9@]+")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]+)*")
TOKEN = re.compile(r"[A-Za-z0-9._%+@:\[\](){}/\\~-]*")
NUMBERS = re.compile(r"[0-9.()/_-]*(?:\x20\(?[0-9][0-9.()/_-]*)*")
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@:[](){}/\\~-")
NEAR = re.compile(r"[^\W_]+|[=:#|]")
LEAST_LENGTH = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out, taken = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > taken and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                taken = m.end()
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Like base_spans, but keys and tokens of unknown kind, apart from all base spans and from each other."""
    keys = {m.start(): m.end() for m in KEY.finditer(text) if NAMED.search(text[max(0, m.start() - 40) : m.start()])}
    spelled = [m.span() for m in SPELLED.finditer(text)] if re.search(r"[\[({](?:at|AT)[\])}]", text) else []
    taken: list[list[int]] = []  # base spans and spelled-out addresses, without overlaps
    for start, end in sorted([*((s, e) for s, _, e in spans), *spelled]):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    free = {(s, e) for s, e in taken}
    out, at, i = [(s, UNKNOWN, e) for s, e in spelled if (s, e) in free and (s, e) not in {(a, b) for a, _, b in spans}], 0, 0
    for m in MARK.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and text[start - 1] in TOKEN_CHARS:
            start -= 1
        end = TOKEN.match(text, m.end()).end()
        if not any(c.isalpha() for c in text[start:end]):
            end = max(end, NUMBERS.match(text, m.end()).end())
        at = end
        left = text[start:end].lstrip(".,:-/_%])}~\\")
        first = end - len(left)
        last = first + len(left.rstrip(".,:-/_%([{~\\"))
        while i < len(taken) and taken[i][1] <= first:
            i += 1
        if last - first >= LEAST_LENGTH and not (i < len(taken) and taken[i][0] < last):
            out.append((first, KINDS.index("secret") if keys.get(first) == last else UNKNOWN, last))
    return sorted(out)


def patterns(text: str, start: int, end: int, reach: int = 80) -> list[str]:
    """Lexical patterns around a place; digits become 0, so that values don't make patterns of their own."""
    before, after = (NEAR.findall(re.sub(r"[0-9]", "0", x.lower())) for x in (text[max(0, start - reach) : start], text[end : end + reach]))
    left = before[-1] if before else "^"
    return ["1 " + left, "2 " + " ".join(before[-2:]), "3 " + left + " _ " + (after[0] if after else "$")]


FOUND = "doc_id long, text_hash long, base array<struct<start:int,rank:int,end:int>>, nodes array<struct<start:int,rank:int,end:int,instance:long,patterns:array<string>>>"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its base spans, and a node for each seed or candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, nodes = [], []
            for text in b["text"]:
                spans = base_spans(text)
                base.append([{"start": s, "rank": r, "end": e} for s, r, e in spans])
                own = [*spans, *candidates(text, spans)]
                nodes.append([{"start": s, "rank": r, "end": e, "instance": xxhash.xxh64_intdigest(text[s:e].encode("utf-8", "replace")) - (1 << 63), "patterns": patterns(text, s, e)} for s, r, e in own])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "base": base, "nodes": nodes})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInPandas(run, FOUND)


def confident_patterns(nodes: DataFrame, turns: int = 10, least: int = 5, damping: float = 2.0, sure: float = 0.8, unknown: float = 0.2) -> DataFrame:
    """nodes: pattern, instance, rank (``UNKNOWN`` for a candidate). (pattern, kind, score) of the patterns that discover.

    ``least`` known instances make a pattern able; a pattern with fewer instances altogether can never be and stays
    out of the turns. Sums by pattern are combined before they are shuffled, and patterns meet their edges by a
    broadcast while they are few, so that a pattern with very many instances stays spread.
    """
    edges = nodes.select("pattern", "instance", "rank").distinct()
    size = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("all")).where(F.col("all") >= least)
    able = stored(edges.join(size, "pattern"), "able")
    seeds = able.where(F.col("rank") != UNKNOWN).select("instance", F.col("rank").alias("kind"), F.lit(1.0).alias("score")).distinct()
    known, before, confident = stored(seeds, "known"), -1, None
    for _ in range(turns):
        met = able.select("pattern", "instance", "all").distinct().join(known, "instance")
        kinds = range(len(KINDS))
        sums = [f for k in kinds for f in (F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"mass{k}"), F.count_if(F.col("kind") == k).alias(f"known{k}"))]
        mass = met.groupBy("pattern").agg(F.first("all").alias("all"), F.count("*").alias("known"), *sums)
        weight = damping + F.col("known") + unknown * F.greatest(F.col("all") - F.col("known"), F.lit(0))
        each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"mass{k}") / weight).alias("score"), F.col(f"known{k}").alias("own")) for k in kinds]))
        scored = mass.select("pattern", each).where((F.col("score") >= sure) & (F.col("own") >= least))
        confident = stored(scored.select("pattern", "kind", "score"), "confident")
        doubt = able.where(F.col("rank") == UNKNOWN).join(few(confident), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        known = stored(seeds.unionByName(doubt.where(F.col("score") >= sure).join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti")), "known")
        now = known.count()
        if now == before:
            break
        before = now
    return confident


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _of_kind(rank: int) -> Callable[[Column], Column]:
    """A test of a span. Of one parameter: Spark hands the place in the array to a second one, default or not."""
    return lambda span: span["rank"] == rank


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, text_hash, base and found, arrays of (start, rank, end)."""
    rows = stored(occurrences(docs, id_col, text_col), "occurrences")
    nodes = rows.select("doc_id", "text_hash", F.explode("nodes").alias("n")).select("doc_id", "text_hash", "n.*", F.explode("n.patterns").alias("pattern")).drop("patterns")
    sure = few(confident_patterns(nodes.select("pattern", "instance", "rank"), **options))
    open_ = nodes.where(~F.col("rank").between(0, len(BASE) - 1)).join(sure, "pattern")
    best = open_.groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    place = F.struct("start", (-F.col("best.kind")).cast("int").alias("rank"), "end")
    found = best.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(place)).alias("found"))
    named = found.select(F.col("doc_id").alias("__tidemark_id"), F.col("text_hash").alias("__tidemark_hash"), "found")
    out = rows.join(named, F.col("doc_id").eqNullSafe(F.col("__tidemark_id")) & (F.col("text_hash") == F.col("__tidemark_hash")), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return out.select("doc_id", "text_hash", "base", F.coalesce("found", empty).alias("found"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found."""
    s = spans(docs, **options)
    counts = {f"n_{k}": F.size(F.filter("base", _of_kind(i))).cast("long") for i, k in enumerate(BASE)}
    both = F.array_sort(F.concat("base", "found"))
    return s.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(both).alias("spans"), F.size("found").cast("long").alias("n_found"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in brackets (overlapping ones by the first); n_chars follows."""
    hit = spans(docs, id_col, text_col, **options).withColumn("s", F.array_sort(F.concat("base", "found"))).where("size(s) > 0")
    hit = hit.select(F.col("doc_id").alias("__tidemark_id"), F.col("text_hash").alias("__tidemark_hash"), "s").dropDuplicates(["__tidemark_id", "__tidemark_hash"]).select("__tidemark_id", "__tidemark_hash", F.col("s").alias("__tidemark_spans"))

    @F.pandas_udf("string")
    def hide(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found, strict=True):
            parts, at = [], 0
            for x in f if f is not None else ():
                if x["start"] >= at:
                    parts += [t[at : x["start"]], f"[{KINDS[x['rank']].upper()}]"]
                at = max(at, x["end"])
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    hit = stored(hit, "hits")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    some, rest = parted(docs, text_hash, hit.select("__tidemark_hash"), "__tidemark_hash")
    some = stored(some, "with_spans")  # few texts; so no task runs two Python functions at once
    joined = some.join(hit, F.col(id_col).cast("long").eqNullSafe(F.col("__tidemark_id")) & (text_hash == F.col("__tidemark_hash")), "left")
    clean = joined.withColumn(text_col, F.when(F.col("__tidemark_spans").isNotNull(), hide(F.coalesce(F.col(text_col), F.lit("")), F.col("__tidemark_spans"))).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__tidemark_spans").isNotNull(), F.char_length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.unionByName(clean.select(*docs.columns))
