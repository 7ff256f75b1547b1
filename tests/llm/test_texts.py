"""Operators on texts: 3, 5, 8, 9, 10 and the pipeline."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
from crease.llm import bpe, chunkdedup, jaccard, langid, linededup
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose, rows_of

MULTI = public.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# -- 10


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe.read_ranks(MULTI)
    return bpe.Codec(ranks, public.PATTERN, leaf=8, run_leaf=4), bpe.Codec(ranks, public.PATTERN)


def test_bpe_equals_the_library_on_odd_texts(codecs):
    rnd = random.Random(5)
    signs = ["a", "the", " ", "  ", "\n", "é", "ß", "1", "23", "'s", "'l", "l", "!", "\t", "日本", "　", "\x1c", "😀", "er", "\xa0"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs[: rnd.choice([3, 8, 20])]) for _ in range(rnd.randint(0, 60)))
        for codec in codecs:
            ids = codec.encode(text)
            assert ids.tolist() == codec.base.encode_ordinary(text), text
            assert codec.decode(ids.astype(np.int64)) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 9000, "a" * 20_000, "1234567" * 3000, " " * 9000 + "x", "x " * 9000 + "  " * 900])
def test_bpe_of_long_runs(codecs, text):
    assert codecs[1].encode(text).tolist() == codecs[1].base.encode_ordinary(text)


def test_bpe_on_spark(hard_docs, hard_rows, clashing, no_docs, codecs):
    ids = bpe.encode(hard_docs, "text", ["doc_id"], MULTI, public.PATTERN)
    back = bpe.decode(ids, "ids", ["doc_id", "ids"], MULTI, public.PATTERN)
    want = sorted(
        (repr(r[0]), codecs[1].base.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in hard_rows
    )
    assert sorted((repr(r.doc_id), list(r.ids), bytes(r.decoded)) for r in back.collect()) == want
    assert rows_of(bpe.encode(clashing, "text", ["doc_id"], MULTI, public.PATTERN)) == rows_of(ids)
    assert bpe.encode(no_docs, "text", ["doc_id"], MULTI, public.PATTERN).count() == 0


# -- 5


def brute_lines(rows, window=3):
    """Later windows' lines removed; rows equal in id and text are one document."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, gone = {}, collections.defaultdict(set)
    for d in docs:
        found = d[1].split("\n")
        for p in range(len(found) - window + 1):
            place = first.setdefault(tuple(found[p : p + window]), (d, p))
            if place != (d, p):
                gone[d] |= set(range(p, p + window))
    out = []
    for r in rows:
        d = (r[0], r[1])
        if r[1] is None:
            out.append((r[0], None, 0, 0))
        else:
            found = r[1].split("\n")
            kept = [x for i, x in enumerate(found) if i not in gone[d]]
            out.append((r[0], "\n".join(kept), len(found), len(found) - len(kept)))
    return sorted(map(repr, out))


def test_line_dedup_equals_brute_force(spark, hard_docs, hard_rows, clashing, no_docs):
    as_rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    # ties of null ids are told apart by a digest of the text, so they stay out of the comparison
    plain = [r for r in hard_rows if r[0] is not None and r[0] != 11]
    df = spark.createDataFrame(plain, hard_docs.schema)
    assert as_rows(linededup.dedup_lines(df, "doc_id", "text")) == brute_lines(plain)
    whole = linededup.dedup_lines(hard_docs, "doc_id", "text")
    assert whole.count() == len(hard_rows)
    assert rows_of(linededup.dedup_lines(clashing, "doc_id", "text")) == rows_of(whole)
    assert linededup.dedup_lines(no_docs, "doc_id", "text").count() == 0


def test_line_dedup_of_repeating_lines(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    rows += [(i, "\n".join(f"line {rnd.randint(0, 30)}" for _ in range(8))) for i in range(60, 120)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_lines(rows)


def test_line_dedup_plan_is_native(hard_docs):
    plan = linededup.dedup_lines(hard_docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 9


def test_chunks_resist_insertions():
    text = prose(3, 3000).encode()
    whole = set(chunkdedup.chunks(text)[1].tolist())
    shifted = set(chunkdedup.chunks(text[:5000] + b" inserted words " + text[5000:])[1].tolist())
    assert len(whole - shifted) <= 3
    at, high, low = chunkdedup.chunks(text)
    assert at[0] == 0 and at[-1] == len(text) and len(high) == len(low) == len(at) - 1
    assert (np.diff(at) > 0).all()


def test_chunk_borders_do_not_depend_on_blocks(monkeypatch):
    text = (prose(3, 3000) + "日本語" * 500).encode()
    whole = chunkdedup.borders(text)
    monkeypatch.setattr(chunkdedup, "BLOCK", 1000)
    assert (chunkdedup.borders(text) == whole).all()
    for a in whole[:-1].tolist():
        assert (text[a] & 0xC0) != 0x80


def test_passages_go_and_unique_texts_stay(spark):
    passage = prose(99, 60)
    rows = [(i, prose(1000 + i, 80) + " " + passage + " " + prose(2000 + i, 50)) for i in range(20)]
    clean = [(100 + i, prose(3000 + i, 150)) for i in range(20)]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string")
    found = {r.doc_id: r for r in chunkdedup.dedup_chunks(df, "doc_id", "text").collect()}
    assert found[0].text == rows[0][1]
    for i, t in clean:
        assert found[i].text == t and found[i].first_docs is None
    for i, t in rows[1:]:
        assert passage not in found[i].text and 0 in found[i].first_docs
        assert len(t) - len(passage) - 2 <= len(found[i].text) < len(t) - 80
    middle = " ".join(passage.split()[25:32])
    assert sum(middle in r.text for r in found.values()) == 1


def plain_borders(text: bytes, half: int = 16) -> list[int]:
    """Borders by their definition, place by place."""
    gear = chunkdedup.GEAR.tolist()
    hashes = {e: sum(gear[text[e - k]] << 2 * k for k in range(8)) & 0xFFFF for e in range(7, len(text))}
    at = {0, len(text)}
    for e in range(7 + half, len(text) - half):
        if all(hashes[e] < hashes[e - k] and hashes[e] <= hashes[e + k] for k in range(1, half + 1)):
            border = e + 1
            while border < len(text) and text[border] & 0xC0 == 0x80:
                border += 1
            at.add(border)
    return sorted(at)


def plain_dedup(rows: list[tuple[int, str]], min_run: int = chunkdedup.MIN_RUN) -> dict[int, str]:
    """Texts without repeated passages by a walk through the documents in order of their ids."""
    held, out = {}, {}
    for i, t in sorted(rows):
        text, seen, kept, run = t.encode(), set(), [], []
        at = plain_borders(text)
        for a, b in zip(at, at[1:], strict=False):
            chunk = text[a:b]
            if chunk in seen or held.get(chunk, i) != i:
                run.append(chunk)
            else:
                kept += [b"".join(run) if sum(map(len, run)) < min_run else b"", chunk]
                run = []
            seen.add(chunk)
            held.setdefault(chunk, i)
        kept.append(b"".join(run) if sum(map(len, run)) < min_run else b"")
        out[i] = b"".join(kept).decode()
    return out


def test_chunk_dedup_against_a_plain_walk(spark):
    rnd = random.Random(12)
    passages = [prose(500 + k, rnd.choice([10, 25, 60])) for k in range(8)] + ["日本語のテキスト。" * 9 + prose(7, 20), "ab" * 300, "ha " * 90]
    rows = []
    for i in range(120):
        parts = [prose(9000 + 10 * i + k, rnd.randint(0, 40)) for k in range(3)]
        rows.append((i, " ".join(p for x in parts for p in (x, rnd.choice([*passages, ""])))))
    rows += [(200, rows[5][1]), (201, ""), (202, "short"), (203, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r.text for r in chunkdedup.dedup_chunks(df, "doc_id", "text").collect()}
    assert found == plain_dedup(rows)
    assert sum(found[i] != t for i, t in rows) > 40 and found[200] == "" and found[203] == "short"


def test_planted_passages_of_51_words_are_found():
    missed = short = 0
    for k in range(1500):
        passage = prose(50_000 + k, 51).encode()
        held = prose(k, 20).encode() + b" " + passage + b" " + prose(10_000 + k, 20).encode()
        text = prose(20_000 + k, 20).encode() + b". " + passage + b"\n" + prose(30_000 + k, 20).encode()
        gone = np.unique(chunkdedup.chunks(held)[1])
        left = chunkdedup.keep_text(text, gone, chunkdedup.MIN_RUN)[0]
        missed += left == text
        short += len(text) - len(left) < len(passage) / 2
    assert missed == 0 and short <= 3


def test_chunk_dedup_of_hard_rows(hard_docs, hard_rows, clashing, no_docs):
    found = chunkdedup.dedup_chunks(hard_docs, "doc_id", "text")
    texts = collections.Counter((r.doc_id, r.text) for r in found.collect())
    assert sum(texts.values()) == len(hard_rows)
    assert texts[8, hard_rows[8][1]] == 3  # rows of one id keep what they share
    assert texts[0, None] == 1 and texts[1, ""] == 1
    assert rows_of(chunkdedup.dedup_chunks(clashing, "doc_id", "text")) == rows_of(found)
    assert chunkdedup.dedup_chunks(no_docs, "doc_id", "text").count() == 0


# -- 3


def shingle_set(text, k):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else frozenset([tuple(words)])


def brute_components(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        groups[root(a)].append(i)
    return sorted((i, len(s), min(groups[root(a)])) for a, (i, s) in enumerate(sets))


def near_rows():
    rnd = random.Random(3)
    words = ["a", "b", "c", "D", "e", "fo", "gé", "h!"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    base = [rnd.choice(words) + str(rnd.randint(0, 50)) for _ in range(120)]
    for i in range(150, 330):
        own = list(base[: rnd.choice([40, 80, 120])])
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    rows += [(330 + i, rnd.choice(rows)[1]) for i in range(30)]
    return [*rows, (400, None), (401, "y" * 3000 + " b"), (402, "Y" * 3000 + "\tB"), (403, "")]


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 9, 10, 1_000_000), (3, 9, 10, 1500), (5, 8, 10, 1500)])
def test_jaccard_equals_brute_force(spark, k, num, den, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(df, "doc_id", "text", k, num, den, block=block)
    assert sorted(map(tuple, found.collect())) == brute_components(rows, k, num, den)


def test_jaccard_of_hard_rows(spark, hard_docs, hard_rows, clashing, no_docs):
    found = jaccard.jaccard_components(hard_docs, "doc_id", "text", 3, 9, 10)
    plain = [(r[0], r[1]) for r in hard_rows if r[0] not in (None, 11)]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df, "doc_id", "text", 3, 9, 10).collect())) == brute_components(plain, 3, 9, 10)
    assert found.count() == len(hard_rows)
    assert {r.component_id for r in found.where("doc_id is null").collect()} == {None, 8}  # equal sets alone
    assert rows_of(jaccard.jaccard_components(clashing, "doc_id", "text", 3, 9, 10)) == rows_of(found)
    assert jaccard.jaccard_components(no_docs, "doc_id", "text").count() == 0


def test_search_reaches_exactly_the_overlap():
    rnd = random.Random(1)
    sets = [np.unique(np.array(rnd.sample(range(60), rnd.randint(1, 40)), dtype=np.uint64)) for _ in range(200)]
    index = jaccard.Index(sets, list(range(len(sets))))
    for num, den in ((9, 10), (6, 10), (3, 10)):
        for q in sets[:60]:
            want = []
            for i, s in enumerate(sets):
                both = len(np.intersect1d(q, s))
                if den * both >= num * (len(q) + len(s) - both):
                    want.append(i)
            assert jaccard.search(index, sets, q, num, den) == want


def test_word_digests_do_not_depend_on_blocks(monkeypatch):
    text = (prose(7, 800) + " " + "z" * 700 + "\t" + prose(8, 100)).encode()
    whole = jaccard.word_digests(text)
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", 256)
    assert (jaccard.word_digests(text) == whole).all()
    assert len(whole) == len(WORD.findall(text))


# -- 8


def test_language_on_held_out_texts(spark):
    marks = {"en": "th ing er", "de": "sch ung ei", "fr": "eau oi ent"}
    rows = []
    for lang, m in marks.items():
        for i in range(60):
            rnd = random.Random(f"{lang}{i}")
            parts = m.split() + ["a", "o"]
            text = " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(rnd.randint(3, 40)))
            rows.append((len(rows), text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1"), "text", "lang", F.xxhash64("doc_id"))
    held = langid.identify(df.where("doc_id % 3 = 1"), "text", ["doc_id", "lang"], model).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_kernel_sets_equal_brute_force():
    text = "Ab,  cd Ü9x"
    shown = " ab cd ü x "
    grams = {shown[i : i + n] for n in (1, 2, 3) for i in range(len(shown) - n + 1)}
    assert langid.n_distinct(langid.buckets(text)) == len(grams)
    assert len(langid.buckets("123 !?")) == 0


def test_language_of_hard_rows(hard_docs, hard_rows, clashing, no_docs):
    model = langid.fit(hard_docs, "text", "lang", F.xxhash64("doc_id", "text"))
    found = langid.identify(hard_docs, "text", ["doc_id", "text"], model)
    rows = found.collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de")) if lettered else (r.lang_pred, r.score) == ("und", 0.0)
    assert rows_of(langid.identify(clashing, "text", ["doc_id", "text"], model)) == rows_of(found)
    assert langid.identify(no_docs, "text", ["doc_id"], model).count() == 0
    assert langid.fit(no_docs, "text", "lang", F.xxhash64("doc_id")) is None
    assert {r.lang_pred for r in langid.identify(hard_docs, "text", [], None).collect()} == {"und"}


@pytest.mark.parametrize("langs", [1, 2, 4])
def test_pipeline_rejects_junk_and_unlearned_languages(spark, langs):
    import corpus_pipeline

    marks = {"en": "th ing er on", "de": "sch ung ei um", "fr": "eau oi ent ai", "es": "cion ado ll ez"}
    speak = lambda rnd, parts, n: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(n))
    rnd, rows = random.Random(6), []
    for lang, m in list(marks.items())[:langs]:
        rows += [(len(rows) + i, speak(rnd, [*m.split(), "a", "o"], rnd.randint(3, 60)), lang, "s", 1) for i in range(90)]
    clean, letters = len(rows), "abcdefghijklmnopqrstuvwxyz"
    for n in (10, 40, 200):
        rows.append((1000 + n, speak(rnd, letters, n), None, "junk", 1))
        rows.append((2000 + n, speak(rnd, ["kw", "jy", "zaa", "vuu"], n), None, "unlearned", 1))
        rows.append((3000 + n, speak(rnd, ["при", "вет", "мир"], n), None, "unlearned", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    left = [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()]
    assert sorted(left) == list(range(clean))


# -- the pipeline


def test_pipeline_stages(spark, hard_docs, hard_rows, no_docs):
    import corpus_pipeline
    from crease.llm.common import stored

    docs = hard_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        texts = [r.text for r in docs.collect()]
        assert all(any(c.isalpha() for c in t) for t in texts)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(8) == 1 and 12 in ids and 9 not in ids  # copies of 8 go, repeated rows too
    assert {r.doc_id: r.text for r in docs.collect()}[8] == hard_rows[8][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == len(set(ids))
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, ""), "test-empty")
        assert empty.count() == 0
