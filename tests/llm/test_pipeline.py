"""The corpus pipeline against a plain Python version of its five stages, and its awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import cases
import corpus_pipeline
import numpy as np
import pytest
from test_edges import brute_links
from tokscope.llm import bpe, decontamination, quality_classifier, secret_scans

SF = "/root/testdata/sf0.001"


def features_score(model, text):
    idx, w = quality_classifier.features(text)
    return float(model.score(np.array([w @ model.weight[idx] + model.bias if len(idx) else model.bias]))[0])


def brute(rows, labels, items):
    """rows: dicts of documents; returns {doc_id: (n_tokens, ids_sha256, decoded_sha256)}."""
    from tokenizers import Tokenizer

    teach = sorted((d["doc_id"], labels[d["doc_id"]], d["text"] or "") for d in rows if labels.get(d["doc_id"]) in (0, 1) and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2)
    model = quality_classifier.train([(y, t) for _, y, t in teach])
    rows = [d for d in rows if features_score(model, d["text"] or "") >= 0.7]

    classes = {doc_id: c for doc_id, c, _ in brute_links([(d["doc_id"], d["text"]) for d in rows])}
    rows = [d for d in rows if classes[d["doc_id"]] == d["doc_id"]]

    def leaks(text):
        words = decontamination.tokens(text)
        have = {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        for item in items:
            q, a = decontamination.question_and_answer(item)
            share = []
            for part in (q, a, item):
                grams = decontamination.ngrams(decontamination.tokens(part))
                share.append(len(grams & have) / len(grams) if grams else 0.0)
            if max(share[0], share[2]) >= 0.5 or (share[1] >= 0.5 and share[0] >= 0.25):
                return True
        return False

    rows = [d for d in rows if not leaks(d["text"])]

    found = {}
    for d in rows:
        spans = []
        for kind, pattern in enumerate((secret_scans.ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+", secret_scans.KNOWN)):
            for m in re.finditer(pattern, d["text"] or ""):
                value = m[2] if kind == 0 else m[0]
                if len(value) >= (12, 18, 16, 0)[kind]:
                    spans.append((m.start(), kind, m.end(), value))
        found[d["doc_id"]] = sorted(spans)
    owners = {}
    for d in rows:
        for *_, value in found[d["doc_id"]]:
            owners.setdefault(value, set()).add(d["source"])
    tok, out = Tokenizer.from_file(bpe.default_tokenizer()), {}
    for d in rows:
        text, at, parts = d["text"] or "", 0, []
        for a, _, b, value in found[d["doc_id"]]:
            if len(owners[value]) < secret_scans.EXAMPLE_OWNERS and len(set(value)) >= secret_scans.MIN_DISTINCT:
                if a >= at:
                    parts += [text[at:a], "[SECRET]"]
                at = max(at, b)
        text = "".join([*parts, text[at:]])
        ids = tok.encode(text, add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        out[d["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_pipeline_equals_brute_force(spark):
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in read("labels")}
    want = brute(read("documents"), labels, [r["text"] for r in read("benchmark")])
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert len(rows) == len(want) > 100


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, tmp_path, empty):
    labels = [(i, 1, 0) for i in (1, 2, 3, 6, 7, 8, 9, 12, 13, 14)] + [(10, 0, 0), (None, 0, None), (11, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cases.items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = cases.no_documents(spark) if empty else cases.documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "encode":
            assert docs.columns == columns
    assert (docs.count() == 0) == empty
