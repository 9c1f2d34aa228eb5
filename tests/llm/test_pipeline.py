"""The pipeline against stage-by-stage brute force."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import quality

from .test_dedup import brute_components, brute_fingerprint
from .test_text import brute_pii
from .test_tokens import well_packed


def hidden(text):
    parts, at = [], 0
    for start, rank, end in brute_pii(text):
        if start >= at:
            parts += [text[at:start], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[rank]]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, states = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        states[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    start = spark.read.parquet(f"{data}/documents.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in quality.scored(start, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in states["quality"]} == {i for i, p in judged.items() if p == 1}

    first = {}
    for r in sorted(states["quality"], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in states["exact_dedup"]) == sorted(first.values())

    group = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in states["exact_dedup"]], 3)
    assert sorted(r["doc_id"] for r in states["simhash"]) == sorted(i for i, c in group.items() if i == c)

    want = {r["doc_id"]: hidden(r["text"]) for r in states["simhash"]}
    assert {r["doc_id"]: r["text"] for r in states["pii"]} == want
    before = {r["doc_id"]: r for r in states["simhash"]}
    for r in states["pii"]:
        changed = r["text"] != before[r["doc_id"]]["text"]
        assert r["n_chars"] == (len(r["text"]) if changed else before[r["doc_id"]]["n_chars"])

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = {}
    for r in states["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == length
    assert well_packed(states["packing"], 4096) <= int(np.ceil(sum(length.values()) / 4096)) + 1


def test_run_equals_stages_and_survives_odd_rows(spark, data, odd, labels, tmp_path):
    assert corpus_pipeline.run(spark, data).count() > 0
    (odd.withColumnRenamed("Fingerprint", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert well_packed(out, 4096) > 0 and {r["doc_id"] for r in out} <= {None, 1, 3, 6, 7, 8, 9}
