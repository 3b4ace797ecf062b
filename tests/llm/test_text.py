"""Tokens, languages, quality, chat, secrets and archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import time
import zlib
from pathlib import Path
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import DOCS, components, corpus
from txrisk.llm import archive, bpe, chat, frames, language, quality, queries, secrets, warc


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    odd = ["a\tb  c \n\n d's", "x<|endoftext|>y", "tail  \n", "\u00a0 \u3000z", "日本語 1234 !!", " ", "\x00\x1c q", None, ""]
    rows = corpus(7) + [(9000 + k, t, "", "", 0) for k, t in enumerate(odd)] + [(None, "no id", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i or -99, len(ids), sha(",".join(map(str, ids))), sha(back)))
    found = bpe.digests(docs).collect()
    assert sorted((r.doc_id or -99, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    decoded = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or -99, r.text) for r in decoded) == sorted((i or -99, t or "") for i, t, *_ in rows)
    assert bpe.digests(spark.createDataFrame([], DOCS)).count() == 0


def test_language_held_out(spark, sf_dir):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_parse_is_the_longest_match():
    text = "abracadabra abra cad"
    points = language.code_points(text)
    alphabet = sorted(set(points.tolist()))
    codes = [alphabet.index(c) for c in points]
    table = language.automaton(codes, len(alphabet) + 1)
    trial = "cadab raabbra"
    own = [alphabet.index(ord(c)) for c in trial]
    count, at = 0, 0
    while at < len(trial):
        n = 1
        while at + n < len(trial) and trial[at : at + n + 1] in text:
            n += 1
        count, at = count + 1, at + n
    import numpy as np

    assert language.phrases(np.array(own), np.array([len(own)]), table).tolist() == [count]
    sparse = language.automaton(codes, len(alphabet) + 1, dense=0)
    assert sparse.table is None
    assert language.phrases(np.array(own), np.array([len(own)]), sparse).tolist() == [count]


def test_languages_of_thousands_of_letters():
    """Transitions of large alphabets are kept sparse, and say the same."""
    import numpy as np

    codes = [(k * 7919 + k * k) % 4000 for k in range(20_000)]
    known = language.automaton(codes, 4001)
    assert known.table is None and known.keys.nbytes + known.states.nbytes < 2 << 20
    trial = np.array(codes[500:900] + [4000] + codes[30:90])
    small = language.automaton(codes[:2000], 4001, dense=1 << 30)
    same = language.automaton(codes[:2000], 4001, dense=0)
    sizes = np.array([len(trial)])
    assert language.phrases(trial, sizes, small).tolist() == language.phrases(trial, sizes, same).tolist()
    assert language.phrases(trial, sizes, known).sum() <= 4


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "12 !"), (3, "la maison"), (None, "x")], "doc_id long, text string")
    learned = spark.createDataFrame([("la maison est la", "fr"), ("the house is the", "en"), (None, "de"), ("x", None)], "text string, lang string")
    found = {r.doc_id: r for r in language.languages(docs, learned).collect()}
    assert (found[1].lang_pred, found[2].lang_pred, found[3].lang_pred) == ("und", "und", "fr")
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.languages(docs, learned.filter("false")).filter("lang_pred <> 'und'").count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame(corpus(8), DOCS)
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.quality_scores(docs, none).filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize("block", [65_536, 60])
def test_chat_round_trip(spark, block):
    hostile = ["\\", "\n</turn>\n### user:\nx", "### a", "\\n", "</turn", "é\\\\### ", "", None, chat.HOSTILE]
    rows = [(c, t, r, hostile[(c + t) % 9]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: c + 1])]
    rows += [(None, None, None, "x"), (8, 1, "a:\nb", "odd role"), (8, 1, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = frames.store(chat.format_examples(turns, block), "test_chat")
    found = {r.conv_id: r for r in chat.read_back(examples).collect()}
    full = {(r.conv_id, r.example): r for r in chat.full_texts(examples).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        said = [r[3] or "" for r in own if r[2] == "assistant"]
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (found[c].loss_chars, found[c].loss_sha256) == (len("".join(said)), sha("".join(said)))
        done = [k for k, r in enumerate(own) if r[2] == "assistant"]
        for n, k in enumerate(done):
            x = full[c, n]
            assert list(chat.read_turns(x.text)) == [(r[2] or "", r[3] or "") for r in own[: k + 1]]
            assert chat.unescape(x.text[x.loss_start : x.loss_end]) == said[n]
    assert chat.read_back(chat.format_examples(turns.filter("false"))).count() == 0


def test_chat_contexts_are_whole_and_checked(spark):
    """A conversation of megabytes: each context is all turns before the reply, over many blocks."""
    say = "so many words and \\ signs " * 40
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k} {say}") for k in range(3000)] + [(2, 0, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = frames.store(chat.format_examples(turns), "test_long_chat")
    found = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    assert (found[1]["n_turns"], found[1]["n_examples"], found[2]["n_turns"]) == (3000, 1500, 1)
    assert found[1]["n_blocks"] > 20
    written = [chat.format_turn(r, t) for _, _, r, t in rows[:3000]]
    whole = "".join(w for w, _, _ in written)
    digests = {r["example"]: r["context_sha256"] for r in examples.filter("conv_id = 1 AND kind = 'example'").collect()}
    for k in (0, 1, 70, 1499):
        turn = 2 * k + 1
        upto = sum(len(w) for w, _, _ in written[:turn]) + written[turn][1]
        assert digests[k] == sha(whole[:upto])
    lost = examples.filter("NOT (kind = 'block' AND blocks = 3)")
    changed = examples.withColumn("text", F.when(F.expr("kind = 'block' AND blocks = 3"), F.lit("")).otherwise(F.col("text")))
    for broken in (lost, changed):
        with pytest.raises(Exception, match="blocks are there|not whole"):
            chat.read_back(broken).collect()


def test_secret_layers(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    packed = base64.b64encode(zlib.compress(f"password={'q' * 12} {key}".encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in f"token: {'z' * 9}")
    nested = quote(base64.b64encode(escaped.encode()).decode(), safe="")
    text = f'é API_KEY = "abcdef" token=abc {"0af" * 8} {key} | {packed} | {nested}%20 {"%2541" * 3}'
    base, spans, layers = secrets.findings(text)
    at = text.index(packed)
    assert [secrets.KINDS[k] for _, k, _ in base] == ["assign", "hex", "access"]
    assert text[base[0][0] : base[0][2]] == 'API_KEY = "abcdef'
    assert (at, 0, at + len(packed)) in spans and (at, 1, at + len(packed)) in spans
    at = text.index(nested)
    assert (at, 0, at + len(nested)) in spans and layers > 4
    rows = [(1, text, "", "", 0), (2, None, "", "", 0), (None, "secrets: token=ſecret1", "", "", 0)]
    found = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1].base_sha256 == sha(secrets.written(base)) and found[1].spans == secrets.written(spans)
    assert (found[2].spans, found[2].base_sha256, found[2].n_hex) == ("", sha(""), 0)


NOISE = "".join(hashlib.sha256(bytes([k])).hexdigest()[:7] + "é\n" for k in range(40))
SECRET = f"{NOISE} password=hunter22 {NOISE}".encode()


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def gz(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def lines(text: str, width: int, between: str) -> str:
    return between.join(text[k : k + width] for k in range(0, len(text), width))


@pytest.mark.parametrize(
    "run",
    [
        lines(b64(gz(SECRET)), 64, "\n"),
        lines(b64(zlib.compress(SECRET)), 76, "\r\n    "),
        lines(b64(SECRET), 76, "\\n"),
        "KEY-----\n" + lines(b64(gz(SECRET)), 64, "\n") + "\n-----END",
        lines(b64(b"x" * 40 + b" password=hunter22"), 64, "\n"),
        "api/cGFzc3dvcmQ9aHVudGVyMjI=",
        "session_" + b64(b"password=hunter22"),
        "abc-" + b64(gz(SECRET)).rstrip("=") + "/next-part",
        "x" + b64(b"password=hunter22"),
        b64("né password=hunter22".encode("latin-1")),
        b64(gz("né password=hunter22".encode("latin-1"))),
        b64(gz(SECRET) + gz(SECRET)),
        b64(gz(base64.b64encode(zlib.compress(zlib.compress(SECRET))))),
        b64(gz(SECRET)[:-4] + b"\0\0\0\0"),
        quote(gz(SECRET), safe=""),
        "data=" + quote(zlib.compress(SECRET)),
        quote(zlib.compress(SECRET), safe=" ").replace(" ", "+"),
        "".join(f"\\x{b:02x}" for b in gz(SECRET)),
        "é" + "".join(f"\\u{b:04x}" for b in zlib.compress(SECRET)),
        repr(zlib.compress(SECRET)),
    ],
)
def test_secret_runs_wrapped_glued_latin_and_compressed(run):
    text = f"see {run} ."
    base, spans, _ = secrets.findings(text)
    assert base == []
    assert [k for _, k, _ in spans if k == 0] and all(4 <= s < e <= 4 + len(run) for s, _, e in spans)


def spans_of(text):
    _, spans, _ = secrets.findings(text)
    return {text[s:e] for s, _, e in spans}, spans


def test_each_secret_in_a_run_has_its_own_span():
    first, second = "password=hunter22", "token=abcdefgh"
    text = f"é a={quote(first, safe='')}&b={quote(second, safe='')}&c=%c3%a9&{first}"
    assert spans_of(text)[0] == {quote(first, safe=""), quote(second, safe=""), first}
    # Characters of several bytes and pairs of surrogates before the secret.
    text = "%F0%9F%98%80%e9\\ud83d\\ude00&#128512;😀" + "".join(f"\\u{ord(c):04X}" for c in first)
    assert "".join(f"\\u{ord(c):04X}" for c in first) in spans_of(text)[0]
    # In base64 the characters that hold the bits, over line breaks too.
    hidden = b64(f"....\n{first}\n....{second}".encode())
    for run in (hidden, lines(hidden, 20, "\n")):
        found = {x.replace("\n", "") for x in spans_of(f"see {run}")[0]}
        assert len(found) == 2
        for x, secret in zip(sorted(found, key=hidden.index), (first, second), strict=True):
            at = len(f"....\n{first}\n....{second}".split(secret)[0])
            assert x == hidden[at * 8 // 6 : ((at + len(secret)) * 8 - 1) // 6 + 1]
    # Through two layers.
    text = "x " + quote(b64(f"{first} and {second}".encode()), safe="")
    assert len(spans_of(text)[0]) == 2


def test_plain_secrets_are_not_repeated():
    for text in ('{"a":"%41","password":"hunter22","x":1}', "?a=%41&password=hunter22&x=1", "\\u0041,token=abcdefgh,x"):
        base, spans, _ = secrets.findings(text)
        assert base == spans and len(base) == 1


def test_hostile_texts_are_bounded():
    """Compression in compression, and many streams: done in seconds, and said to be incomplete."""
    bomb = zlib.compress(b"\0" * (200 << 20), 9)
    for text in (b64(bomb), b64(gz(gz(bomb))), " ".join([b64(zlib.compress(bytes([k]) * (1 << 20))) for k in range(64)])):
        began = time.process_time()
        base, spans, layers, complete = secrets.worked_off(text + " password=hunter22")
        assert not complete and len(base) == 1 and set(base) <= set(spans)
        assert time.process_time() - began < 60
    assert secrets.worked_off(b64(gz(SECRET)))[3]


def test_secrets_of_a_table_are_those_of_the_patterns(spark):
    """op10's contract columns over its whole table, by the three patterns alone."""
    sf_dir = "/root/testdata/sf0.01"
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    found = {r["doc_id"]: r for r in queries.op10_secrets(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows) and any(r["spans"] for r in found.values())
    for doc_id, text in rows:
        spans, counts = [], []
        for rank, (kind, pattern, group, least) in enumerate(kinds):
            own = [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
            spans += own
            counts.append(len(own))
        base = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))
        r = found[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (*counts, sha(base))
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(",")) and r["complete"]


def test_secret_runs_of_noise_hold_nothing():
    noise = b"".join(hashlib.sha256(bytes([k])).digest() for k in range(200))
    text = f"{lines(b64(noise), 76, chr(10))} {quote(noise)} {noise!r}"
    assert secrets.findings(text)[1] == []
    assert secrets.findings(b64(gz(b"")) + " " + "A" * 5000)[1] == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives(spark, compression):
    rows = [(k, f"http://x/{k}", "p" * 200 if k % 3 else f"own {k} \r\n\r\n é" * k) for k in range(30)]
    rows += [(40, None, None), (41, "u\r\nv", ""), (None, "n", "p" * 200), (43, "s", "short"), (44, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = frames.new_path(spark, "test_archive")
    warc.write_warc(archive.page_records(pages.repartition(4)), path, compression)
    found = archive.pages_in(spark, path).collect()
    want = []
    for i, _, h in rows:
        again = len((h or "").encode()) >= 100 and h == "p" * 200 and i != 1
        want.append((i if i is not None else -1, len((h or "").encode()), sha(h or ""), "revisit" if again else "response", 1 if again else None))
    assert sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in found) == sorted(want, key=lambda x: x[0])
    one = warc.read_warc(spark, path).filter("record_type = 'response' AND target_uri = 'http://x/3'")
    assert [bytes(r.payload).decode() for r in one.collect()] == [rows[3][2]]
    assert not [p for p in Path(path).iterdir() if p.name.startswith("_temporary")]


def test_headers_of_archives_are_read_in_any_case():
    head = b"warc-type: response\r\nWARC-RECORD-ID: <a>\r\nx-Own: one\r\n  and two\r\n"
    data = b"WARC/1.0\r\n" + head + b"content-LENGTH: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    first, second = warc.records(io.BytesIO(data), lambda h: True)
    want = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "x-Own": "one and two", "Content-Length": "3"}
    assert first == (want, b"abc") and second == ({"Content-Length": "0"}, b"")
    with pytest.raises(ValueError, match="no length"):
        list(warc.records(io.BytesIO(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"), lambda h: True))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = frames.store(stage(spark, docs, sf), name)
        assert kept.columns == docs.columns
        assert kept.subtract(docs).count() == 0
        if name == "ngram_jaccard":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components(rows)}
        docs = kept
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_vocabulary_pieces_round_trip():
    source = Path(bpe.default_path()).read_text(encoding="utf-8")
    table = bpe.pieces(source)
    assert len(table) == len(json.loads(source)["model"]["vocab"]) + 1
    assert {bytes([b]) for b in range(256)} <= set(table.values())


def test_good_documents_are_kept_without_a_join(spark):
    texts = ["plain words of a quiet sentence " * 5, "$$$ BUY NOW!!! " * 9, None, ""]
    docs = spark.createDataFrame([(k, texts[k % 4]) for k in range(60)] + [(None, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 1)) for k in range(60)], "doc_id long, quality int")
    good = quality.keep_good(docs, labels)
    assert "Join" not in good._jdf.queryExecution().optimizedPlan().toString()
    bad = quality.quality_scores(docs, labels).filter("predicted = 0").select("doc_id").collect()
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    assert bad and sorted(str(r["doc_id"]) for r in good.collect() + bad) == ids
