"""Operators that return one row per text, against the libraries and brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import TEXTS, docs, empty, rows

from barloom.llm import piece_codec, quality_rules, token_counts

P = pytest.importorskip("public_tokenizers")


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_piece_codec_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter()
    for r in rows():
        ids = lib.encode(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    assert got(piece_codec.piece_digests(docs(spark), P.path("piece_bpe_32k.model"))) == want
    full = piece_codec.piece_codec(docs(spark), P.path("piece_bpe_32k.model")).collect()
    assert sorted(str((r[0], r[1], r[3])) for r in full) == sorted(str((r[0], ids := lib.encode(r[1] or ""), lib.decode(ids))) for r in rows())
    assert piece_codec.piece_digests(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_agenda_by_arrays_and_by_heap_agree():
    c = piece_codec.load(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    words = [" " * int(rng.integers(1, 4)) + "".join(rng.choice(list("abcdeéñ中𝄞\x01tionheingr"), int(rng.integers(1, 36)))) for _ in range(3000)]
    ids = c.encode_segments(words)
    assert ids == [c._bytes(c._by_heap(c.of_char[[ord(x) for x in w.replace(" ", "▁")]].tolist())) for w in words]
    assert ids == [c.library.encode(w[1:]) for w in words]
    assert [c.decode(i) for i in ids] == [c.library.decode(i) for i in ids] == [w[1:] for w in words]


def test_decode_of_broken_bytes():
    c = piece_codec.load(P.path("piece_bpe_32k.model"))
    b = c.byte_ids
    for ids in ([b[0xC3]], [b[0xE4], b[0xB8]], [264, b[0xF0], 264], [b[0xC3], b[0xA9]], []):
        assert c.decode(ids).count("a") == c.library.decode(ids).count("a")


def test_difference_from_the_library_raises():
    c = piece_codec.load(P.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError):
        c._verify([" a", " b"], [[264], [264]])
    with pytest.raises(ValueError):
        c._verify(["  "], [[264]])


@pytest.mark.parametrize("entries", [0, 5, 1 << 18])
def test_token_counts_are_the_library(spark, entries):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows():
        n = len(lib.encode(r[1] or "", add_special_tokens=False))
        want[(r[0], len((r[1] or "").encode()), n, n > 512)] += 1
    df = token_counts.count_tokens(docs(spark), P.path("byte_bpe_50k.json"), entries=entries)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got(df) == want
    assert token_counts.count_tokens(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_pre_tokens_of_every_plain_character():
    v = token_counts.load(P.path("byte_bpe_50k.json"))
    checked = 0
    for c in map(chr, range(0x3000)):
        if token_counts.PLAIN.fullmatch(c):
            t = f"a{c}b {c} {c}{c}1 2{c} \n{c}{c}\n  {c}"
            assert v.find(t) == [t[a:b] for _, (a, b) in v.library.pre_tokenizer.pre_tokenize_str(t)], hex(ord(c))
            checked += 1
    assert checked > 500


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, again = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            again |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)


def test_quality_statistics(spark):
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_cascade(docs(spark)).collect()}
    want = {(r[0], *(s := brute_rules(r[1])), s[0] < 50 or 2 * s[4] > s[0]) for r in rows()}
    assert found == want
    assert quality_rules.quality_cascade(empty(spark)).count() == 0


def test_verdict_is_the_same_in_any_order(spark):
    d = docs(spark, [(i, t * k, None, None, None, None, None) for k in (1, 30) for i, t in enumerate(["Good words and more of them here.\n", "LOUD!! WORDS!!\n", "a$$$ b%%% c###\n", *[x or "" for x in TEXTS]])])
    first = got(quality_rules.quality_cascade(d).drop("rejected_by"))
    again = got(quality_rules.quality_cascade(d, rules=quality_rules.RULES[::-1]).drop("rejected_by"))
    assert first == again
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns
    assert kept.count() == sum(n for r, n in first.items() if r[-1])


def test_rules_order_by_rejection_per_cost():
    r = quality_rules.RULES[:3]
    seen = {r[0].name: (1.0, 0.5), r[1].name: (0.1, 0.2), r[2].name: (1.0, 0.0)}
    assert [x.name for x in quality_rules.ordered(r, seen)] == [r[1].name, r[0].name, r[2].name]
