"""Every training-data query against a plain counterpart, on hard cases and on empty tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tests.llm import brute, fixtures

from incidentlens.llm import bpe, pii, queries, substring
from incidentlens.llm.decontaminate import contamination

DOCS = fixtures.documents()
TEXTS = [(row[0], row[1]) for row in DOCS]


def rows_of(df, *names):
    return Counter(tuple(row[n] for n in names) for row in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert df.count() == (1 if name.startswith("op5_") else 0)


def test_decontaminate(spark, hard):
    got = rows_of(queries.op1_decontaminate(spark, hard), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter(brute.contamination(TEXTS, [r[:2] for r in fixtures.benchmark(DOCS)]))


def test_decontaminate_without_benchmark(spark, hard, empty):
    docs, none = spark.read.parquet(f"{hard}/documents.parquet"), spark.read.parquet(f"{empty}/benchmark.parquet")
    assert {r["n_hit"] for r in contamination(docs, none).collect()} == {0}


def test_bpe(spark, hard):
    ranks = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc, text in TEXTS:
        ids = library.encode_ordinary(text or "")
        want[doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or "")] += 1
    assert rows_of(queries.op2_byte_bpe(spark, hard), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_appends_and_edits():
    voc = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path(queries.RANKS)))
    whole = b"antidisestablishmentarianism 1234567 \xc3\xa9\xc3\xa9\xff\x00 xyzzyxyzzy"
    growing = bpe.PrefixEncoder(voc)
    for i in range(len(whole)):
        growing.append(whole[i : i + 1])
        assert growing.ids() == bpe.PrefixEncoder(voc, whole[: i + 1]).ids()
        assert [voc.bytes[t] for t in growing.ids()] == voc.merged(whole[: i + 1])
    growing.edit(4, 9, b"QQ")
    assert growing.ids() == bpe.PrefixEncoder(voc, whole[:4] + b"QQ" + whole[9:]).ids()


def test_bpe_separate_steps(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id int, text string, decoded string")
    path = public_tokenizers.path(queries.RANKS)
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in out.collect()} == {1: b"a b", 2: b""}


def test_components(spark, hard):
    got = rows_of(queries.op4_ngram_join(spark, hard), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.components(TEXTS))


def test_substring(spark, hard):
    got = rows_of(queries.op6_substring(spark, hard), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(brute.without_repeats(TEXTS))


def test_substring_shared_ids(spark, monkeypatch):
    """What is to be removed is listed per text, not per id, and equal rows are read once."""
    rng = random.Random(9)
    passage = fixtures.prose(rng, 30)
    texts = [(i % 2 or None, f"{fixtures.prose(rng, 5 + i)} {passage} {fixtures.prose(rng, 25)}") for i in range(30)]
    twice = passage + " and " + passage
    texts += [(None, twice)] * 12 + [(7, twice)] * 3 + [(8, texts[0][1]), (None, None), (None, ""), (-(1 << 63), texts[2][1])]
    seen, cut = [], substring._cut
    monkeypatch.setattr(substring, "_cut", lambda df: seen.append(df.selectExpr("count(*) n", "max(size(fates)) most").first()) or cut(df))
    got = rows_of(substring.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")), "doc_id", "n_words", "n_removed", "kept_sha256")
    plain = brute.without_repeats([(-1 if d == -(1 << 63) else d, t) for d, t in texts])  # before all others, as null is
    assert got == Counter((d, *row[1:]) for (d, _), row in zip(texts, plain))
    assert seen[0]["n"] <= 33 and seen[0]["most"] <= 80


def test_personal_data(spark, hard):
    got = {(r["doc_id"], r["base_sha256"]): r for r in queries.op8_pii(spark, hard).collect()}
    by_id = dict(TEXTS)
    for doc, text in TEXTS:
        found = brute.personal(text)
        row = got[doc, brute.sha(",".join(found))]
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(f.startswith(k + ":") for f in found) for k in ("email", "ip", "card", "phone")
        ]
        assert set(found) <= set(row["spans"].split(",")) | {""}
    kinds = {s.split(":")[0] for r in got.values() for s in r["spans"].split(",")}
    assert {"iban", "ssn", "birth", "key"} <= kinds
    (doc,) = [d for d, t in by_id.items() if t and t.startswith("ssn")]
    (row,) = [r for (d, _), r in got.items() if d == doc]
    assert row["spans"].count("ssn:") == 1  # the second number has no context word near it
    (doc,) = [d for d, t in by_id.items() if t and t.startswith("card")]
    (row,) = [r for (d, _), r in got.items() if d == doc]
    assert row["spans"].count("iban:") == 1 and row["n_card"] >= 1


def test_secrets():
    """Long mixed runs near a word such as token or password; neither prose nor lone digests."""
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    found = lambda text: [text[s.start : s.end] for s in pii.spans(text) if s.kind == "secret"]
    assert found(f'token = "{digest}"') == found(f"export API_KEY={digest}") == [digest]
    assert found("password: aB3dE6gH9jK2mN5pQ8sT== then") == ["aB3dE6gH9jK2mN5pQ8sT"]
    for text in (f"commit {digest}", "token " + "a1" * 30, "token antidisestablishmentarianisms", "secret 12345678901234567890123",
                 "key " + "-" * 40, f"token {digest[:19]}", "token" + " far" * 15 + digest):
        assert not found(text)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    marked = [t for t in texts if re.search('token = "[0-9a-f]{40}"', t or "")]
    assert len(marked) > 5 and all(found(t) for t in marked)
    assert sum(bool(found(t)) for t in texts) == len(marked)


def test_line_rules(spark, hard):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    df = queries.op9_line_rules(spark, hard)
    assert rows_of(df, *names) == Counter((d, *brute.line_statistics(t)) for d, t in TEXTS)
    kept = {r["doc_id"]: r["kept"] for r in df.collect()}
    shouting = [d for d, t in TEXTS if t and t.startswith("WORD!!")]
    assert not any(kept[d] for d in shouting) and kept[10]


def test_chat(spark, hard):
    rows = fixtures.conversations()
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said, ""), (-7, 1, "assistant", said, "")]
    by_conv: dict = {}
    low = lambda v: (v is not None, v if v is not None else "")
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (low(r[1]) if r[1] is not None else (False, -1), low(r[2]), low(r[3]))):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    want = Counter()
    for conv, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv, len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), brute.sha(loss)] += 1
    got = rows_of(queries.op5_chat_format(spark, hard), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == want


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[at:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:at].translate(brute.AZ), path[:end]


def test_urls(spark, hard):
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in queries.op10_url_filter(spark, hard).collect())
    want = Counter()
    rules = sorted(queries.URL_RULES, key=lambda r: -len(r.text))
    for page, url, *_ in fixtures.pages():
        host, path = url_parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want[page, host, path, fits[0].text if fits else None] += 1
    assert got == want
    verdicts = {r.text: r.verdict for r in rules}
    for row in queries.op10_url_filter(spark, hard).collect():
        assert row["verdict"] in ("allow", "block")
        if row["rule"]:
            assert row["verdict"] == verdicts[row["rule"]]


def test_toxicity_rows(spark, hard):
    rows = queries.op3_toxicity(spark, hard).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in TEXTS)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_quality_rows(spark, hard):
    rows = queries.op7_quality(spark, hard).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in TEXTS)
    for r in rows:
        assert r["kept"] or r["units"] == 0 or r["log_ppl"] > 0
        assert (r["units"] == 0) == (r["log_ppl"] is None) and not (r["units"] == 0 and r["kept"])
