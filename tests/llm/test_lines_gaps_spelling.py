"""Line deduplication, fill-in-the-middle and spelling variants against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest
from tidewire.llm import fill_middle as fm
from tidewire.llm import line_dedup as ld
from tidewire.llm import registry, spelling

from tests.llm.test_dedup import SCHEMA, frame

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, key string, gone string, pos string, n string, form string, word string, row_key string, at string, h1 string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * 9)) for r in rows], CLASHING)


def plain_lines(rows, min_docs=2, min_chars=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(ld.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        lines, own = (t or "").split("\n"), ld.NO_ID if i is None else i
        stay = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and min(held[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


LINES = [
    (1, "A long first line\nshort\n\n  a LONG first line\t\nalone in here"), (2, "a long first line\nshort\nother text of two"), (3, None), (4, ""), (5, "other text of two\x0b\n\n"), (5, "a second row of five\nother text of two"),
    (6, "\n".join(f"line number {k % 5000}" for k in range(20_000))), (7, "\n".join(f"LINE number {k}" for k in range(0, 9000, 2))), (8, "nine char\nÉÉÉÉÉÉÉÉÉÉ"), (9, "nine char\nÉÉÉÉÉÉÉÉÉÉ\nééééééééé"), (9, "nine char\nÉÉÉÉÉÉÉÉÉÉ\nééééééééé"),
    (None, "a line of rows without id\nother text of two"), (None, "a line of rows without id"), (10, "x" * 200_000 + "\n" + " " * 200_000 + "y"), (11, "X" * 200_000), (-3, "other text of two"), (12, "a line separator"), (13, " nbsp at the ends \nnbsp at the ends"), (14, "nbsp at the ends"),
] + [(100 + k, f"a line that all of these hold\nown {k} of all these") for k in range(300)]


@pytest.mark.parametrize("least", [2, 3])
def test_lines_match_the_definition(spark, least):
    got = sorted((tuple(r) for r in ld.deduplicate_lines(clashing(spark, LINES), min_docs=least).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert got == plain_lines(LINES, least) and sum(r[2] for r in got) > 250


def test_no_lines(spark):
    assert ld.deduplicate_lines(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ld.deduplicate_lines(frame(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


TEXTS = ["", None, "a", "word", "two words", "<P>", "a<S>b", "<M", "x < P> y", "é à 1234", "<" * 7, "line\nline\r\n\tx", "😀 smile 😀", "a" * 5000, "ab " * 700 + "é" * 700 + "z" * 1500, "a" * 511 + "b" + "c" * 513, " " * 1024, "<P" + "a" * 511 + "S>" + "<S", "\x00 nul", "K K kelvin ſ"]


def plain_gap(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return i, len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out, text


def test_gaps_match_the_definition(spark):
    rows = [(k * 37 + j if k * 37 + j != 40 else None, t) for k in range(12) for j, t in enumerate(TEXTS)]
    got = fm.fill_in_middle(clashing(spark, rows)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fm.restored().alias("restored")).collect()
    want = sorted((plain_gap(*r) for r in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(frame(spark, [])).count() == 0


def test_units_of_random_texts():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Z" * rng.randrange(1, 900), " ", "é", "\n", "1" * rng.randrange(5)]) for _ in range(rng.randrange(30)))
        units, found = re.findall("[A-Za-z]+|[^A-Za-z]", text), fm.Units(text)
        assert found.n == len(units)
        assert all(found.end(k) == len("".join(units[:k])) for k in {rng.randrange(len(units) + 1) for _ in range(20)} | {0, len(units)})


def test_a_very_long_text_keeps_little(spark):
    long = "letters" * 400_000 + " and words" * 100_000
    r = fm.fill_in_middle(spark.createDataFrame([(5, long), (5, long)], "doc_id long, text string")).select("n", "output", fm.restored().alias("t")).collect()
    assert len(r) == 2 and r[0] == r[1] and r[0]["t"] == long and r[0]["n"] == 400_001


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, noise=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_variants(n, pairs):
    out, form = {}, {}
    for w in n:
        best = min(pairs.get(w, ()), key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(pairs.get(w, ())), n.get(form[w]))
    return out


def all_pairs(n):
    pairs = {}
    for a in n:
        for b in n:
            if abs(len(a) - len(b)) <= 1 and a != b and near(a, b):
                pairs.setdefault(a, set()).add(b)
    return pairs


def variants_of(df, **options):
    return {r["word"]: tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df, **options).collect()}


BASES = ["colour", "colours", "analyse", "harbour", "labour", "Müller", "naïveté", "aaaaaa", "abcabcabc", "listen", "silent", "ÀÉÎÕÜß", "×÷×÷×÷"]


def misspelt(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcdeé×") + word[k:], word[:k] + rng.choice("abcdeé") + word[k + 1 :], word[:k] + word[k:][::-1]])


@pytest.mark.parametrize("noise", [199, 3])
def test_variants_match_every_pair(spark, noise):
    rng = random.Random(noise)
    rows = [(None, None), (1, ""), (2, "short words are no use"), (None, "colour colour Colour\nCOLOUR"), (3, "long" * 30_000), (3, "long" * 30_000), (4, "x1y2z3 " * 50)]
    pool = BASES + [misspelt(rng, b) for b in BASES for _ in range(25)]
    pool += [misspelt(rng, w) for w in pool]
    weights = [600 if k < len(BASES) else rng.choice([1, 4, 30, 160]) for k in range(len(pool))]
    rows += [(10 + k // 2, rng.choice([" ", ", ", "\n", "9", "_"]).join(rng.choices(pool, weights, k=2000))) for k in range(40)]
    rows += [(500 + k, "long" * 30_000) for k in range(5)]
    n = plain_words(rows, noise)
    want = plain_variants(n, all_pairs(n))
    assert variants_of(clashing(spark, rows), noise=noise) == want
    assert any(w[1] and w[2] != w[1] for w in want.values()) and sum(w[4] for w in want.values()) > 500 and "long" * 30_000 in want


def test_anagrams_are_not_near_by_their_key(spark):
    """Words of the same letters meet on the half that stays, and only those in order are near."""
    rng = random.Random(3)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(400)} | {"".join(rng.sample("abcdefghi", 9)) for _ in range(400)}
    words |= {"abcdefghij", "abcdefghi", "abcdefghix", "abcdeghij"}
    rows = [(k, " ".join(sorted(words))) for k in range(5)]
    n = plain_words(rows, 1 << 40)
    got = variants_of(spark.createDataFrame(rows, "doc_id long, text string"), noise=None)
    assert got == plain_variants(n, all_pairs(n)) and sum(r[4] for r in got.values()) >= 6
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), ratio=1)
    assert spelling.spelling_variants(frame(spark, [])).count() == 0 and len(SCHEMA) > 0


@pytest.mark.skipif(not os.path.exists(f"{SMALL}/documents.parquet"), reason="tables are not there")
def test_op13(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    n, pairs, holes = plain_words(rows), {}, {}
    for w in n:  # words that are equal but for one place meet in the place's hole
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    for w in n:
        found = {v for k in range(len(w)) for v in holes[w[:k], w[k + 1 :]]} | {w[:k] + w[k + 1 :] for k in range(len(w))} & n.keys()
        for v in found - {w}:
            pairs.setdefault(w, set()).add(v)
            pairs.setdefault(v, set()).add(w)
    got = {r["word"]: tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in registry.queries()["op13_spelling"](spark, SMALL).collect()}
    assert got == plain_variants(n, pairs) and len(got) > 500
