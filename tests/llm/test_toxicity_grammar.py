"""Each transducer of the toxicity grammar, the composed one against plain rules, and held-out labels."""

import re

import numpy as np
import pytest

from kurtosia.llm import toxicity


def told(text, cues=None):
    return dict(zip(toxicity.FEATURES, toxicity.Scorer(cues or {"idiot": 5.0, "scum": 3.0})(text), strict=True))


@pytest.mark.parametrize(
    ("text", "context"),
    [
        ("You are an idiot.", "plain"),
        ("They said: you are an idiot.", "reported"),
        ('She wrote: "You are an idiot."', "reported"),
        ('She wrote: "Go home. You are an idiot."', "reported"),
        ("He said “Go home. Leave. You idiot”", "reported"),
        ('She wrote: "Go home." You are an idiot.', "plain"),
        ('"Go home." You idiot', "plain"),
        ("She wrote a letter. You are an idiot.", "plain"),
        ("You are not an idiot.", "negated"),
        ("You are not, in any way at all, an idiot.", "negated"),
        ("He is not here. You are an idiot.", "plain"),
        ("You are not tall but an idiot.", "plain"),
        ("I do not like this, you idiot.", "plain"),
        ("He never said that she is an idiot", "negated"),
        ("idiot, she said", "plain"),
    ],
)
def test_context_of_an_insult(text, context):
    f = told(text)
    assert {c for c in toxicity.CONTEXTS if f[f"{c}_top"]} == {context}


@pytest.mark.parametrize(
    ("text", "threat", "aimed"),
    [
        ("I will kill you.", 1, 1),
        ("The frost will kill it.", 1, 0),
        ("I will not kill you.", 0, 0),
        ("They said they will kill you.", 0, 0),
        ("Kill. You", 1, 0),
        ("nothing here", 0, 0),
    ],
)
def test_threats_and_targets(text, threat, aimed):
    f = told(text)
    assert (f["threat"], f["aimed_threat"]) == (threat, aimed)


def test_insults_count_as_aimed_only_plainly_and_in_one_clause():
    assert told("you idiot")["aimed_top"] == 5 and told("an idiot. you")["aimed_top"] == 0 and told("you are no idiot")["aimed_top"] == 0
    f = told("you idiot and scum")
    assert f["plain_top"] == 5 and f["plain_sum"] == pytest.approx(np.log1p(8))


def test_grammar_against_plain_rules():
    """Random clauses of one line, without quotations: what the machines say by definition."""
    rng = np.random.default_rng(1)
    pool = ["idiot", "scum", "kill", "you", "not", "said", "but", ",", "word", "other", "tree"]
    scorer = toxicity.Scorer({"idiot": 5.0, "scum": 3.0})
    for _ in range(2000):
        words = [str(w) for w in rng.choice(pool, int(rng.integers(1, 9)))]
        want = dict.fromkeys(toxicity.FEATURES, 0.0)
        negated = reported = comma = False
        plain, threat = 0.0, False
        for w in words:
            if w == "not":
                negated, comma = True, False
                continue
            if w == "but" or (w == "you" and negated and comma):
                negated = False
            if w == "said":
                reported = True
            if w in ("idiot", "scum"):
                x = 5.0 if w == "idiot" else 3.0
                context = "negated" if negated else "reported" if reported else "plain"
                want[f"{context}_top"] = max(want[f"{context}_top"], x)
                want[f"{context}_sum"] += x
                plain = max(plain, x) if context == "plain" else plain
            if w == "kill" and not negated and not reported:
                threat = True
            comma = w == ","
        aimed = "you" in words
        want["aimed_top"] = plain if aimed else 0.0
        want["threat"], want["aimed_threat"] = float(threat), float(threat and aimed)
        if not set(words) & {"idiot", "scum", "kill"}:
            want = dict.fromkeys(toxicity.FEATURES, 0.0)
        for c in toxicity.CONTEXTS:
            want[f"{c}_sum"] = np.log1p(want[f"{c}_sum"])
        got = dict(zip(toxicity.FEATURES, scorer(re.sub(" ,", ",", " ".join(words))), strict=True))
        assert got == pytest.approx(want), words


def test_a_score_column_of_the_table_gives_way(spark):
    docs = spark.createDataFrame([(1, "x", 9.0), (2, "you idiot", 9.0)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.toxicity for r in toxicity.score(docs, labels).collect()}
    assert out[1] < 0.5 < out[2] <= 1
