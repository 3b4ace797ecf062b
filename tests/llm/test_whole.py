"""Queries over whole tables against brute force; odd tables for every operator and stage."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import components, words
from txrisk.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    language,
    ngram_join,
    pieces,
    quality,
    queries,
    secrets,
    substring_dedup,
)

#: Columns that helpers of the operators might use, beside those of documents.
CLASHING = (
    "_id _hash _found _row row own0 own1 gone0 gone1 id digest chunk bucket words text_hash words_digest "
    "row_key item_id component_id predicted score rank first n token part value"
).split()


def table(spark, sf_dir, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# --- language and quality, from their definitions --------------------------------


def letters(text):
    """Lower-case letters, other runs as one blank, as a string."""
    lower = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return re.sub(" +", " ", lower).removeprefix(" ") if lower.strip() else ""


def phrase_count(text, training):
    count = 0
    for k in range(0, len(text), language.SEGMENT):
        part, at = text[k : k + language.SEGMENT], 0
        while at < len(part):
            # A letter that the language does not have opens the phrase of what follows it.
            n = 1 + (part[at] not in training and at + 1 < len(part) and part[at + 1] in training)
            at, n = at + n - 1, 1
            while at + n < len(part) and part[at : at + n + 1] in training:
                n += 1
            at, count = at + n, count + 1
    return count


def test_op5_is_cross_parsing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 4000)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    by_lang: dict[str, set] = {}
    for i, text, lang in docs:
        if remainder(i, 3) != 1 and text is not None and lang is not None:
            by_lang.setdefault(lang, set()).add(text)
    bound = min(4000, language.TOTAL_CHARS // len(by_lang))
    low, high = language.GOOD_LENGTH
    training = {}
    for lang, texts in by_lang.items():
        parts, total = [], 0
        for t in sorted(texts, key=lambda t: (not low <= len(t) <= high, hashlib.sha256(t.encode()).hexdigest())):
            if total < bound:
                part = letters(t) + " "
                parts.append(part[: 2 * bound])
                total += len(part)
        training[lang] = "".join(parts)
    found = {r["doc_id"]: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for i, text, _ in docs:
        own = letters(text)
        r = found[i]
        assert r["held_out"] == (remainder(i, 3) == 1)
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        rates = sorted((phrase_count(own, t) * np.log2(len(t) + 1), lang) for lang, t in sorted(training.items()))
        assert r["lang_pred"] == rates[0][1]
        assert r["score"] == pytest.approx(rates[1][0] / (rates[0][0] + rates[1][0]))


def plain_quality(docs, labels):
    """Scores of (doc_id, text) by the normal densities of both classes, written out."""
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs}
    rows = {k: np.array([x[i] for i, q in labels if q == k and i in x and remainder(i, 4) != 2]) for k in (0, 1)}
    total = sum(map(len, rows.values()))
    own = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    pooled = np.diag(np.diag(sum(own[k] * len(rows[k]) for k in rows) / total))
    log = {}
    for k, v in rows.items():
        cov = (1 - quality.SHRINKAGE) * own[k] + quality.SHRINKAGE * pooled + quality.FLOOR * np.eye(len(pooled))
        away = {i: y - v.mean(axis=0) for i, y in x.items()}
        log[k] = {
            i: np.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d)
            for i, d in away.items()
        }
    return {i: 1 / (1 + np.exp(np.clip(log[0][i] - log[1][i], -700, 700))) for i in x}


def test_op8_is_discriminant_analysis(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    want = plain_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    found = {r["doc_id"]: r for r in queries.op8_quality(spark, sf_dir).collect()}
    assert set(found) == set(want)
    for i, score in want.items():
        r = found[i]
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert (r["held_out"], r["predicted"]) == (remainder(i, 4) == 2, int(r["score"] >= 0.7))


# --- the pipeline, stage by stage ----------------------------------------------------


def plain_pipeline(docs, labels, items, path):
    from tokenizers import Tokenizer

    scores = plain_quality(docs, labels)
    kept = [(i, t) for i, t in docs if scores[i] >= 0.7]
    first: dict[str, int] = {}
    for i, t in kept:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[text] = min(i, first.get(text, i))
    kept = [(i, t) for i, t in kept if first[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] == i]
    near = {i for i, _, c in components(kept) if c == i}
    kept = [(i, t) for i, t in kept if i in near]

    def shingles(text):
        w = words((text or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    wanted = [s for s in (shingles(t) for t in items) if s]
    kept = [(i, t) for i, t in kept if not any(100 * len(shingles(t) & s) >= 75 * len(s) for s in wanted)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    out = set()
    for i, t in kept:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        out.add((i, len(ids), *sha))
    return out


def test_pipeline_is_that_of_brute_force(spark, sf_dir):
    want = plain_pipeline(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "labels", "doc_id", "quality"),
        [t for (t,) in table(spark, sf_dir, "benchmark", "text")],
        bpe.default_path(),
    )
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(found) == len(want) > 50
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == want


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Null, empty, repeated and very long texts, rows without an id; columns that clash."""
    say = " ".join(f"word{k % 97} and{k % 31}" for k in range(60))
    rows = [(1, say), (1, say), (2, None), (3, ""), (None, say + " more"), (4, "x"), (5, say.upper()), (None, None)]
    rows.append((6, " ".join(f"w{k * 7919 % 100_003}" for k in range(150_000))))
    rows.append((7, "unbroken" * 100_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_odd_documents(spark, sf_dir, odd_documents, name, stage):
    kept = stage(spark, odd_documents, sf_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == odd_documents.columns
        assert kept.exceptAll(odd_documents).count() == 0
    assert 0 < kept.count() <= odd_documents.count()
    assert stage(spark, odd_documents.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: substring_dedup.remove_repeats(d, cell_bits=16),
        ngram_join.near_groups,
        bpe.digests,
        exact_dedup.decisions,
        pieces.digests,
        secrets.secret_spans,
        lambda d: language.languages(d, d.select("text", F.lit("xx").alias("lang"))),
        lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
    ],
    ids="substring near bpe exact pieces secrets language quality".split(),
)
def test_operators_of_odd_documents(spark, odd_documents, operator):
    """A row for every row, the same for rows that are the same, and none of an empty table."""
    rows = operator(odd_documents).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_documents.select("doc_id").collect())
    one = [tuple(v for k, v in r.asDict().items() if k != "kept") for r in rows if r["doc_id"] == 1]
    assert one[0] == one[1]
    assert operator(odd_documents.limit(0)).count() == 0


def test_other_operators_of_odd_documents(spark, odd_documents):
    items = odd_documents.filter("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text", "rank")
    assert {r["doc_id"] for r in decontaminate.leaks(odd_documents, items).collect()} >= {1, 5, None}
    turns = odd_documents.select(
        F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), "text", "rank"
    )
    back = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_examples(turns)).collect()}
    assert back == {1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 6: 1, 7: 1}
