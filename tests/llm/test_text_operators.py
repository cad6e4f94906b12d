"""Quality rules, language ID, BPE and license scans against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from common import edge_docs, edge_rows, empty_docs
from conftest import SF
from lakeweave.llm import bpe, lanes, language_id, license_scan, near_dedup, quality
from lakeweave.llm.license_rules import BASE, gate, needed, rules
from lakeweave.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, which):
    return edge_docs(spark) if which == "edge" else spark.read.parquet(f"{SF}/documents.parquet")


def quality_figures(text):
    w = WORDS.findall(text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(w)

    def twice(k):
        return {g for g, c in Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).items() if c > 1}

    low, high = 0, n
    while low < high:  # a repeat of k words holds one of k - 1 words
        k = (low + high + 1) // 2
        low, high = (k, high) if twice(k) else (low, k - 1)
    fives = twice(5)
    in_repeats = {i + j for i in range(n - 4) if tuple(w[i : i + 5]) in fives for j in range(5)}
    failed = n < 20 or 100 * len(covered) > 30 * n
    longest = low if low >= 5 else 0
    kept = not failed and 100 * len(in_repeats) <= 35 * n and not (longest > 40 and 100 * longest > 20 * n)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, kept, len(in_repeats), longest


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_quality(spark, which):
    docs = docs_of(spark, which)
    got = sorted((tuple(r) for r in quality.quality_rules(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *quality_figures(r.text)) for r in docs.collect()), key=repr)
    assert {g[7] for g in got} == {True, False}


def test_quality_method(spark):
    base = [f"x{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:200] + base[:100])), (3, " ".join(base + base[50:60])), (4, " ".join(base[:200] + [f"y{i}" for i in range(200)] + base[40:130]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert [got[i].longest_repeat for i in (1, 2, 3, 4)] == [0, 100, 10, 90]
    assert [got[i].covered_words for i in (1, 2, 3, 4)] == [0, 200, 20, 180]
    assert [got[i].base_failed for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, True, False]
    spans = {tuple(r) for r in quality.repeated_spans(docs).collect()}
    assert spans == {(2, 0, 100), (2, 200, 100), (3, 50, 10), (3, 400, 10), (4, 40, 90), (4, 400, 90)}


def test_longest_repeat_by_brute_force():
    from lakeweave.llm.textkernel import pieces
    import pyarrow as pa
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 60))) for _ in range(150)]
    for i, j, t in pieces(pa.array(texts), 1 << 9):
        got = quality.measure(t)
        for k in range(i, j):
            want = quality_figures(texts[k])
            assert (got["n_words"][k - i], got["n_repeat_words"][k - i], got["covered_words"][k - i], got["longest_repeat"][k - i]) == (want[0], want[4], want[7], want[8])


def test_filters_keep_columns(spark):
    docs = edge_docs(spark)
    for kept in (quality.quality_filter(docs), language_id.language_filter(docs)):
        assert kept.schema == docs.schema
        assert 0 < kept.count() < docs.count()
        assert kept.exceptAll(docs).count() == 0
    keys = {tuple(r) for r in quality.quality_rules(docs).where("kept").select("doc_id", "n_words").collect()}
    assert {(r.doc_id, len(WORDS.findall(r.text))) for r in quality.quality_filter(docs).collect()} == keys


def test_empty_tables(spark):
    docs = empty_docs(spark)
    for made in (quality.quality_rules(docs), quality.quality_filter(docs), language_id.language_id(docs), language_id.language_filter(docs), bpe.digests(bpe.encode_decode(docs, *tokenizer())), license_scan.license_scan(docs)):
        assert made.count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    got = [tuple(r) for r in language_id.language_id(edge_docs(spark)).collect()]
    texts = {r[0]: r[1] for r in edge_rows()}
    assert len(got) == len(edge_rows())
    for d, held, lang, score in got:
        if d in (2, 3, 4):
            assert (lang, score) == ("und", 0.0)
        elif d not in (None, 200) and any(c.isalpha() for c in texts[d]):
            assert lang in ("en", "de")
    unlabelled = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}


def test_language_never_reads_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    swapped = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end as lang")
    pick = lambda f: sorted(tuple(r) for r in language_id.language_id(f).collect())
    assert pick(docs) == pick(swapped)


def plain_profiles(texts):
    """Bundles by the definition, n-gram by n-gram."""
    letter = lambda c: ord(c.lower()[0]) if c.isalpha() else 0
    made = {}

    def vector(p):
        if p not in made:
            made[p] = language_id.letter_vectors(np.array([p]))[0].astype(int)
        return made[p]

    out = []
    for text in texts:
        p, v = [letter(c) for c in text or ""], np.zeros(language_id.DIMENSIONS, int)
        for (a, b, c), n in Counter(g for g in zip(p, p[1:], p[2:]) if g[1]).items():
            v += n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        out.append(v)
    return out


def test_language_by_brute_force(spark):
    """Predictions and scores against prototypes made n-gram by n-gram; Cyrillic and Chinese letters have vectors of their own."""
    rows_ = [(r.doc_id, r.text[:400], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows_ += [(1000 + i, " ".join(("слово мир дом река поле" if i % 2 else "чайник экран щука хлеб цирк").split()[i % 5 :] * 3), "ru" if i % 2 else "uk") for i in range(12)]
    rows_ += [(2000 + i, "漢字仮名交じり文" * (i + 1), "ja") for i in range(6)] + [(3000, None, "en"), (3001, "12 34", None), (3002, "", "en"), (3003, "a", None), (3004, "ab", "en")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    bundles = plain_profiles([r[1] for r in rows_])
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows_]
    protos = {name: sum(v for v, r, h in zip(bundles, rows_, held) if r[2] == name and not h and r[1] is not None) for name in sorted({r[2] for r in rows_ if r[2]})}
    protos = {k: v for k, v in protos.items() if np.any(v)}
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for (d, text, _), v, h in zip(rows_, bundles, held):
        cosines = {k: v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12) for k, p in protos.items()}
        best = max(cosines, key=cosines.get)
        has = any(c.isalpha() for c in text or "")
        assert got[d].held_out == h and got[d].lang_pred == (best if has else "und")
        assert abs(got[d].score - (min(max(cosines[best], 0), 1) if has else 0)) < 1e-5
    assert {"ru", "uk", "ja"} <= {r.lang_pred for r in got.values()}


def test_language_filter_rejects(spark):
    """Random letters and languages that nobody taught go; documents stay."""
    import random

    r = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(150)) for _ in range(40)]
    noise += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Все люди рождаются свободными и равными в своем достоинстве и правах."]
    more = spark.createDataFrame([(10**6 + i, x, None) for i, x in enumerate(noise)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in language_id.language_filter(docs.unionAll(more)).select("doc_id").collect()}
    assert not any(d >= 10**6 for d in kept) and len(kept) > 0.99 * docs.count()


def test_language_memory(monkeypatch):
    """Very many short texts: no array of all texts by all n-grams."""
    import random

    import pyarrow as pa
    from lakeweave.llm.textkernel import pieces

    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(25)) for _ in range(3000)]
    _, _, run = next(pieces(pa.array(texts)))
    sizes, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength=0, **k: sizes.append(minlength) or plain(x, minlength=minlength, **k))
    v, _ = language_id.vectors(run)
    assert max(sizes) <= language_id.CELLS
    assert all((v[i] == p).all() for i, p in enumerate(plain_profiles(texts[:20])))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_bpe_digests(spark, tik, which):
    docs = docs_of(spark, which)
    want = []
    for r in docs.collect():
        ids = tik.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(bpe.encode_decode(docs, *tokenizer())).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_any_text(tik):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    coder = bpe.codec(*tokenizer())
    alphabet = st.one_of(st.sampled_from(list("abcdest'lrvm  \n\t.,!12é 中\U0001f600")), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet, max_size=60))
    def check(text):
        ids = tik.encode_ordinary(text)
        assert coder.encode_text(text) == ids
        assert "".join(coder.decode_text(ids, 3)) == text

    check()
    for text in ("a" * 4000, " " * 3000 + "x", "ab" * 2000, "'s 'store don't I'll''ve", "\r\n \r\n"):
        assert coder.encode_text(text) == tik.encode_ordinary(text)


def test_bpe_small_caches(tik, monkeypatch):
    monkeypatch.setattr(bpe, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(lanes, "STATES", 30)
    coder = bpe.Codec(*tokenizer())
    for n in range(30):
        text = f"unusual{n} wordings{n * 7} and moreover{n}ness"
        assert coder.encode_text(text) == tik.encode_ordinary(text)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_strings_that_polynomial_hashes_confuse(tik, n):
    """A Thue-Morse string and its complement: told apart as pieces, words, lines and shingles."""
    import pyarrow as pa
    from lakeweave.llm.textkernel import pieces

    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    text = f"{one}\n{two}"
    coder = bpe.codec(*tokenizer())
    assert coder.encode_text(text) == tik.encode_ordinary(text)
    assert "".join(coder.decode_text(coder.encode_text(text))) == text
    _, _, texts = next(pieces(pa.array([text, one, two])))
    assert quality.measure(texts)["n_dup_lines"].tolist() == [0, 0, 0]
    sets, first = near_dedup.shingle_sets(texts, 3)
    assert sets[first[1]] != sets[first[2]]


def test_equal_hashes_of_different_bytes(tik, monkeypatch):
    """Whatever the hash says, bytes decide: ids, words and lines are right even if all hashes are equal."""
    import pyarrow as pa
    from lakeweave.llm.textkernel import Texts, pieces

    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends: np.full(len(starts), 7, np.uint64))
    coder = bpe.Codec(*tokenizer())
    for text in ("one two three two unusualness", "again and again unusualnesses"):
        assert coder.encode_text(text) == tik.encode_ordinary(text)
    text = "a b c\nd e f\na b c\n" + "a b c d e f g h " * 2
    got = quality.measure(next(pieces(pa.array([text])))[2])
    assert [int(got[k][0]) for k in ("n_words", "n_dup_lines", "n_repeat_words")] == list(quality_figures(text)[:1] + quality_figures(text)[3:5])


def test_long_pieces_are_emitted_on_the_way(tik, monkeypatch):
    monkeypatch.setattr(bpe, "LOOK", 200)
    coder = bpe.Codec(*tokenizer())
    for text in ("ab" * 3000, thue_morse(5000), "a" * 3000, "abcdefghij" * 500, "\u00e9t\u00e9" * 700):
        assert coder.encode_text(text) == tik.encode_ordinary(text)


def test_bpe_other_pattern():
    coder = bpe.Codec(tokenizer()[0], r"\S+|\s+")
    assert b"".join(coder.machine.bytes_of[i] for i in coder.encode_text("two  words")) == b"two  words"


def test_utf8_stream():
    text = "aé漢😀z"
    stream = bpe.Utf8Stream()
    parts = [stream.feed(bytes([b])) for b in text.encode()]
    assert "".join(parts) == text and all("�" not in p for p in parts) and stream.close() == ""
    assert bpe.Utf8Stream().feed(b"\xffa") == "�a"


# License scans
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(lower)
    places = [(i, label, len(p.split())) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = sorted({label for _, label, _ in places})
    norm = " " + " ".join(w) + " "
    dets = []
    for r in rules():
        for m in re.finditer(f" {r.regex}(?= )", norm):
            at = norm[: m.start()].count(" ")
            dets.append((at, at + m.group().count(" "), r.priority, r.label))
    stay = set()
    for d in set(dets):
        rivals = [e for e in set(dets) if e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]]
        if not any((e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3]) for e in rivals):
            stay.add(d)
    best = max((d[2] for d in stay), default=0)
    labels = sorted(set(base) | {d[3] for d in stay})
    starts = [p[0] for p in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), max(0.95 if places else 0.0, best * 0.25)


LICENSES = [
    "Released under the MIT License. Again: under the MIT license, under the mit LICENSE",
    "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3, or the GNU Lesser General Public License version 2.1",
    "Licensed under CC BY-NC 4.0 and CC0 1.0 Universal; see creativecommons.org/licenses/by-sa/4.0",
    "cc by ncx cc-by-nc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the license",
    "The new BSD license. Redistribution under the terms of the zlib license. Mozilla Public License 2.0", "dedicated to the public domain. Copyright 2020 Someone. All rights reserved.",
    "https://opensource.org/licenses/BSD-3-Clause and WTFPL license", "no such thing here", "licence agreement: end user licence agreement",
]


#: Notices as whole documents, without the word that most of them have.
BARE = [
    "This program is distributed under the GPL v3.", "Released under Apache 2.0.", "provided under the terms of the new BSD", "Published under the Mozilla Public 2.0", "available under the zlib/libpng",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "released under the OpenRAIL-M", "under the M\u0130T license \u212a under the MIT L\u0130CENSE", "\u00c9T\u00c9 under the MIT license \u00dcBER",
]


@pytest.mark.parametrize("which", ["edge", "sf", "licenses"])
def test_license_scan(spark, which):
    docs = spark.createDataFrame(list(enumerate(LICENSES + BARE)), "doc_id long, text string") if which == "licenses" else docs_of(spark, which)
    want = [(r.doc_id, *scanned(r.text)) for r in docs.collect()]
    got = [tuple(r) for r in license_scan.license_scan(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_license_rules():
    made = rules()
    assert len(made) > 200 and len(set(made)) == len(made) and {r.priority for r in made} <= {1, 2, 3, 4}
    found = {x for t in LICENSES for x in scanned(t)[5].split(",")}
    assert {"mit", "apache-2", "gpl-3", "lgpl-2.1", "cc-by-nc", "cc0-1", "cc-by-sa", "bsd-3-clause", "zlib", "mpl-2", "public-domain", "all-rights-reserved", "wtfpl"} <= found
    assert {"gpl-3", "apache-2", "bsd-3-clause"} <= {x for t in BARE for x in scanned(t)[5].split(",")}


def test_license_keywords():
    """Every match of every rule has the rule's keywords and passes the gate: sample matches made from the regexes."""
    import random

    r, made = random.Random(1), rules()
    passes = re.compile(gate(made))

    def sample(regex):
        if len(parts := branches(regex)) > 1:
            return sample(r.choice(parts))
        out, i = "", 0
        while i < len(regex):
            if regex[i] == "(":
                depth, j = 0, i
                while True:
                    depth += (regex[j] == "(") - (regex[j] == ")")
                    j += 1
                    if not depth:
                        break
                atom, i = (lambda body=regex[i + 3 : j - 1]: sample(body)), j
            elif regex[i] == "[":
                j = regex.index("]", i)
                body = regex[i + 1 : j]
                letters = body if "-" not in body else "".join(map(chr, range(ord(body[0]), ord(body[2]) + 1)))
                atom, i = (lambda x=letters: r.choice(x)), j + 1
            else:
                atom, i = (lambda x=regex[i]: "q" if x == "." else x), i + 1
            low, high = 1, 1
            if regex[i : i + 1] in ("?", "*", "+"):
                low, high = {"?": (0, 1), "*": (0, 2), "+": (1, 2)}[regex[i]]
                i += 1
            elif regex[i : i + 1] == "{":
                low, high = map(int, regex[i + 1 : regex.index("}", i)].split(","))
                i = regex.index("}", i) + 1 + (regex[regex.index("}", i) + 1 :][:1] == "?")
            out += "".join(atom() for _ in range(r.randint(low, min(high, low + 3))))
        return out

    def branches(regex):
        out, depth = [""], 0
        for c in regex:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append("")
            else:
                out[-1] += c
        return out

    for rule in made:
        assert needed(rule.regex), rule
        for _ in range(12):
            text = f" x {sample(rule.regex)} y "
            assert re.search(f" {rule.regex}(?= )", text), (rule, text)
            assert passes.search(text), (rule, text)
            assert all(any(x in text for x in clause) for clause in needed(rule.regex)), (rule, text)
