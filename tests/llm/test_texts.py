"""Secret scan, BPE and URL filter against plain re-implementations."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dwellgrid.llm import bpe, secret_scan, url_filter
from tests.llm.cases import no_documents, odd_documents, plain

KINDS = {
    "assign": (re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
               lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute_spans(text):
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, (pattern, fits)) in enumerate(KINDS.items())
             for m in pattern.finditer(text or "") if fits(m)]
    return ",".join(s for _, _, s in sorted(found))


SECRETS = [
    "password=hunter22", "PassWord : 'abc.def=='", "token=abc", "secret=token:abcdefg", "api_key=\"abcdef\"", "APIKEY:=x12345",
    "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "xAKIAAKIA" + "Q1" * 10, "0123456789abcdef01234567", "0123456789abcdef0123456",
    "é東 secret = 0123456789abcdef0123456789 ☃ token=aaaaaa", "ſecret=abcdefgh", "toKen=abcdefgh", "passwd==abcde", "", None,
    "password=" + "a" * 30_000 + " token: bcdefgh", "token='x secret=zzzzzz", "x" * 70_000 + " api_key = q+/_.=-",
]


def test_secrets_match_plain_search(spark):
    rows = [(i if i % 5 else None, t, "clash", "c") for i, t in enumerate(SECRETS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, id string")
    got = plain(secret_scan.span_digests(secret_scan.find_secrets(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    want = []
    for doc_id, text, *_ in rows:
        spans = brute_spans(text)
        counts = tuple(len(re.findall(k + ":", spans)) for k in KINDS)
        want.append((doc_id, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert got == sorted(want, key=repr)
    assert secret_scan.find_secrets(no_documents(spark)).count() == 0


def test_rules_without_trigrams_and_with_alternatives(spark):
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("abc|d") is None
    assert secret_scan.trigram_query("(?i:ABCD)x*") == ("and", ("tri", "abc"), ("tri", "bcd"))
    assert secret_scan.trigrams_of(secret_scan.trigram_query("(foo|bart)[0-9]+baz")) == {"foo", "bar", "art", "baz"}
    docs = spark.createDataFrame([(1, "foo1baz"), (2, "bart22baz foo"), (3, "foo baz")], "doc_id long, text string")
    rule = secret_scan.SecretRule("word", "(foo|bart)[0-9]+baz")
    found = secret_scan.span_digests(secret_scan.find_secrets(docs, rules=[rule]), base=[rule])
    assert [(r.doc_id, r.spans) for r in found.orderBy("doc_id").collect()] == [(1, "word:0:7"), (2, "word:0:9"), (3, "")]


def test_scan_plan_has_no_python(spark):
    plan = secret_scan.span_digests(secret_scan.find_secrets(odd_documents(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


PARTS = ["'s", "'T", "'re", " ", "\n", "\x1c", "\x85", "\u2003", "a", "É", "e\u0301", "Σ", "ΑΣ ", "İ", "²", "12", "!?", "<|", "|>",
         "<|endoftext|>", "<|startoftext|>", "世界", "🙂", "the", "tion", "ning", "\u0323\u0300", "가", "\x00", "\u1c89", "\ua7ce"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=14).map("".join))
def test_codec_agrees_with_the_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = bpe.codec(bpe.vocabulary_path()).encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert bpe.codec(bpe.vocabulary_path()).decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    codec = bpe.BpeCodec(bpe.vocabulary_path())
    for word in ("inininthethering", "a" * 90, "nationalisation" * 9, "ab" * 40):
        short = codec.first_parts(word)
        assert codec.merge_long(list(short)) == (codec.merge_short(short) or short)


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_CHUNKS", 3)
    small, usual = bpe.BpeCodec(bpe.vocabulary_path()), bpe.codec(bpe.vocabulary_path())
    text = "one two three four five six one two seven three " * 5
    assert small.encode(text) == usual.encode(text)
    assert len(small.chunks) <= 3


def test_tokens_of_odd_documents(spark, library):
    docs = odd_documents(spark)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert plain(bpe.token_digests(bpe.encode_documents(docs))) == sorted(want, key=repr)
    assert bpe.encode_documents(no_documents(spark)).count() == 0


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "HTTP://a.Example.NET/en/1?q#f", "x://example.net/en",
    "x://notexample.net/en/", "http://evil.com/x.net/en/", "http://example.com/de/", "http://www.example.com/DE/", "a://b.org/fr/://c.net/",
    "http://org?x=/fr/", "http://org#/fr/", "http://user@x.org:80/fr/", "http://.org/fr/a", "http://É.org/fr/é", "http://a\n.net/\n?",
    "http://" + "a." * 40_000 + "net/", "http://x.com/" + "de/" * 40_000, "http://x.example.com//de/", "http://example.com.net/de/",
]


def test_urls_match_plain_rules(spark):
    rows = [(n % 7 or None, u, "clash", "c") for n, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    assert plain(url_filter.judge_urls(pages)) == sorted(((i, *brute_url(u)) for i, u, *_ in rows), key=repr)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="acdegnorx./fmp:", max_size=24), min_size=1, max_size=20))
def test_automaton_of_several_words(tails):
    rules = [url_filter.UrlRule(v, h, p) for v, h, p in RULES]
    rules += [url_filter.UrlRule("block", f"host{i}.example.org", f"/path{i}/") for i in range(20)]
    automaton = url_filter.GlobAutomaton(rules)
    assert automaton.width > 4
    for tail, best in zip(tails, automaton.first_rule([t.encode() for t in tails])):
        host, slash, path = tail.partition("/")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and (slash + path).startswith(r.path)]
        assert (automaton.rules[best].text if best >= 0 else None) == (max(fits, key=lambda r: len(r.text)).text if fits else None)
