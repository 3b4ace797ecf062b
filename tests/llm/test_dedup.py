"""De-duplication, near copies and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from txrisk.llm import decontaminate, exact_dedup, ngram_join, substring_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()
DOCS = "doc_id long, text string, chunk string, digest string, n long"


def corpus(seed: int, copies: int = 12) -> list[tuple]:
    """Small documents with copies, near copies, shared passages and odd rows; extra columns clash in name."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    passage, base = say(20), say(60)
    texts = [say(r.randrange(1, 60)) for _ in range(20)] + [None, "", " \n\t ", "one", "One", "a b c d", "a b c d e"]
    texts += [base.replace(" ", "  ", k) for k in range(copies)]
    for k in range(copies):
        words = base.split()
        for _ in range(k % 5):
            words[r.randrange(60)] = f"changed{r.randrange(9)}"
        texts.append(" ".join(words))
    texts += [f"{say(r.randrange(0, 30))} {passage} {say(r.randrange(0, 30))}" for _ in range(8)]
    texts += ["x " * 3000, "ÄÖ e\u0301 \u2003wide " + passage.upper(), "nul \x00 byte " * 5]
    ids = r.sample(range(-50, 5000), len(texts))
    rows = [(i, t, "c", "d", 1) for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[0]]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("heavy", [1, 1000])
def test_exact_decisions(spark, heavy):
    rows = corpus(1)
    found = exact_dedup.decisions(spark.createDataFrame(rows, DOCS), heavy=heavy).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(norm(r[1]).encode()).hexdigest(), []).append(r[0])
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == sorted(
        (i, min(g), len(g), d) for d, g in groups.items() for i in g
    )
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, DOCS), heavy=heavy)
    assert kept.columns == ["doc_id", "text", "chunk", "digest", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_without_ids_and_rows(spark):
    rows = [(None, "a", "", "", 0), (None, "a", "", "", 0), (4, "a", "", "", 0), (None, "b", "", "", 0)]
    found = exact_dedup.decisions(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in found) == [(-1, False), (-1, False), (-1, True), (4, True)]
    assert exact_dedup.decisions(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup.keep_first(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bits", [10, 20])
def test_substring_dedup(spark, bits):
    rows = corpus(2)
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5), cell_bits=bits).collect()
    least: dict[tuple, int] = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(i, least.get(key, i))
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + o for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for o in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(want)
    assert any(r.n_removed for r in found)


def test_substring_without_ids_and_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(None, text, "", "", 0), (3, text, "", "", 0), (5, text, "", "", 0)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), cell_bits=12).collect()}
    assert found == {None: 0, 3: 0, 5: 30}
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS), cell_bits=12).count() == 0


def components(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(lower(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {k: k for k in range(len(sets))}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("leaders", [(8, 64, 512), (1,)])
def test_near_groups(spark, monkeypatch, leaders):
    whole = ngram_join.class_links
    monkeypatch.setattr(ngram_join, "class_links", lambda c, s: whole(c, s, leaders))
    rows = corpus(3, copies=25)
    found = ngram_join.near_groups(spark.createDataFrame(rows, DOCS)).collect()
    want = components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    kept = ngram_join.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "chunk", "digest", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


def test_near_groups_of_nothing(spark):
    assert ngram_join.near_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "", "", "", 0), (2, None, "", "", 0), (None, "a b", "", "", 0)]
    found = ngram_join.near_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.n_shingles) for r in found) == [(0, 0, 1), (1, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("probed", [20_000, 0])
def test_leaks(spark, probed):
    rows = corpus(4)
    r = random.Random(5)
    items = []
    for k, (_, t, *_) in enumerate(x for x in rows if len(words(x[1])) > 3):
        w = words(t)
        a = r.randrange(max(1, len(w) - 20))
        part = w[a : a + r.randrange(3, 40)]
        if k % 3 == 0:
            part[len(part) // 2] = "other"
        items.append((k, " ".join(part)))
    items += [(900, None), (901, ""), (902, "One"), (903, items[0][1])]
    found = decontaminate.leaks(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), probed_values=probed
    ).collect()

    def shingles(t):
        w = words((t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, t, *_ in rows:
        for k, s in items:
            a, b = shingles(t), shingles(s)
            if b and 100 * len(a & b) >= 75 * len(b):
                want.add((i, k, len(a & b), len(b)))
    assert sorted((x.doc_id, x.item_id, x.n_shared, x.n_shingles) for x in found) == sorted(want)
    clean = decontaminate.decontaminate(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {x.doc_id for x in clean.collect()} == {x[0] for x in rows} - {x[0] for x in want}


def test_items_without_an_id_are_taken_out(spark):
    texts = [f"{' '.join(f'{k}w{n}' for n in range(20))}" for k in range(3)]
    docs = spark.createDataFrame([(k, f"so {t} on", "", "", 0) for k, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [2]


def test_leaks_of_nothing(spark):
    docs, none = spark.createDataFrame(corpus(6), DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
