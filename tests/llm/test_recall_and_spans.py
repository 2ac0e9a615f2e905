"""Recall of the graph search on the given vectors, spans of secrets against plain regular expressions, and token ids against the tokenizer."""

import re
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kurtosia.llm import nn_descent, packing, secret_scan


def test_recall_on_the_given_vectors(spark):
    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows if r.embedding is not None])
    m = np.array([r.embedding for r in rows if r.embedding is not None], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = {}
    for r in nn_descent.op1(spark, at).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q]
        s[q] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        hits += len(set(best.tolist()) & found[int(ids[q])].keys())
        total += 5
        assert all(abs(v - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, v in found[int(ids[q])].items())
    assert hits / total >= 0.9


def _plain(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(secret_scan.BASE.items()):
        for m in re.finditer(pattern.replace(r"\x20", " "), text):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_against_plain_regular_expressions(spark):
    rng = np.random.default_rng(4)
    bits = ["password", ": ", "=", '"', "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", " ", "é", "\n", "token", "hunter2hunter2", "API_KEY", "x", "𝒳", "Secret", ".", "https://h/x"]
    rows = [(i, "".join(str(b) for b in rng.choice(bits, int(rng.integers(0, 60))))) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {i: _plain(t or "") for i, t in rows}


def test_time_grows_with_the_matches_of_one_text(spark):
    took = []
    for n in (20_000, 40_000):
        text = " ".join(f"{i:016x}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = secret_scan.find_secrets(docs).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()
        took.append(time.perf_counter() - began)
        assert r.n == n and tuple(r["last"]) == (17 * (n - 1), 2, 17 * n - 1)
    assert took[1] < 3 * took[0] + 2


def test_ids_equal_those_of_the_tokenizer_as_it_is(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.document_encoder()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n x", "<|endoftext", "|endoftext|>  ", "a  b\n\n c", "été 12 ½ 東京\t\tend "]
    for text in texts:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
