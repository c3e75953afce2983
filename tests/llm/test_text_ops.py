"""Token files, chat formatting, decontamination, packing, extraction and toxicity, on small cases."""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewire.llm import chat, html_text, packing, toxicity
from tidewire.llm import token_files as tf
from tidewire.llm.decontaminate import contamination, decontaminate, tile
from tidewire.llm.shared import new_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = ["Hello, world!\nA second line.", "", None, "a  b", " lead", "tail ", "x\n\ny", "tab\tbed", "don't 'tis it's.", "naïve, café!!", "１２ ３", "　wide　", "<|endoftext|> a", "a\x1cb c", "日本語 text", "w " * 5000 + "end"]


@pytest.fixture(scope="module")
def encoder():
    return tf.WordEncoder(BPE)


def test_words_give_the_librarys_ids(encoder):
    own = [t or "" for t in TEXTS]
    assert encoder.encode(own) == [encoder.library(t) if t else b"" for t in own]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z.,'!\n\té日1  -"), max_size=40))
def test_any_text_gives_the_librarys_ids(encoder, text):
    assert encoder.encode([text])[0] == (encoder.library(text) if text else b"")


def test_token_files_round_trip(spark, encoder):
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, start string")
    out = new_folder(spark, "tok")
    tf.write_token_files(docs, BPE, out, seq_len=64, shard_bytes=4000)
    got = {r["doc_id"]: r for r in tf.read_token_digest(spark, out).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = np.concatenate([np.frombuffer(encoder.library(t or ""), "<u2"), [2]]).astype("<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len({r["shard"] for r in got.values()}) > 1
    empty = new_folder(spark, "tok")
    tf.write_token_files(docs.limit(0), BPE, empty)
    assert tf.read_token_digest(spark, empty).count() == 0


@pytest.fixture(scope="module")
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def fresh_ids(fresh, text):
    return np.array(fresh.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes()


SPECIAL = ["<|endoftext|> a", "a <|endoftext|>", "x<|endoftext|>y z", "<|endof text|>", "No special, here."]


def test_ids_are_those_of_a_fresh_tokenizer(encoder, fresh):
    own = [t or "" for t in TEXTS] + SPECIAL
    assert encoder.encode(own) == [fresh_ids(fresh, t) for t in own]
    assert np.frombuffer(encoder.encode(SPECIAL[:1])[0], "<u2")[0] == 50256
    text = tf.WordEncoder(BPE, special_as_text=True)
    assert 50256 not in np.frombuffer(text.encode(SPECIAL[:1])[0], "<u2")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ.,'!\n é×÷ʰßжҁ҂日1_-<|>\u1e9e") | st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_many_texts_give_a_fresh_tokenizers_ids(encoder, fresh, texts):
    assert encoder.encode(texts) == [fresh_ids(fresh, t) for t in texts]


def test_memory_of_parts_is_bounded(encoder, fresh, monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 20)
    own = tf.WordEncoder(BPE)
    for k in range(30):
        texts = [f"word{'abcdefgh'[k % 8]}x common {'qrstuvwxyz'[k % 10] * j}, again.\nline" for j in range(1, 9)]
        assert own.encode(texts) == [fresh_ids(fresh, t) for t in texts]
        assert len(own.parts) <= 40


def test_letters_are_letters():
    import re
    import unicodedata

    kind = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), tf.LETTERS) + "]")
    assert all(unicodedata.category(chr(c)).startswith("L") for c in range(0x600) if kind.match(chr(c)))


def test_token_files_of_odd_ids(spark, fresh):
    rows = [(5, "b"), (None, "n"), (5, "a"), (5, "b"), (2, "x <|endoftext|>"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    out = new_folder(spark, "tok")
    tf.write_token_files(docs, BPE, out, seq_len=4, wide=True)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tf.read_token_digest(spark, out).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.concatenate([np.frombuffer(fresh_ids(fresh, t), "<u2"), [2]]).astype("<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_shards_say_how_large_their_batches_are(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BATCH_SEQS", 3)
    fs, root = tf.file_system(f"file://{tmp_path}")
    w = tf.ShardWriter(fs, f"{root}/s", 4, "<u4")
    ids = np.arange(4 * 3 * 5 + 6, dtype="<u4")
    for k in range(0, len(ids), 7):
        w.add(k, ids[k : k + 7].tobytes())
    w.close()
    monkeypatch.setattr(tf, "BATCH_SEQS", 100)
    s = tf.TokenShard(f"file://{tmp_path}/s")
    assert len(s) == 17 and s.batch_seqs == 3 and s.ids(0, len(ids)).tolist() == ids.tolist()
    assert [s.sequence(k)[0].tolist() for k in (16, 0, 7)] == [[64, 65, 0, 0], [0, 1, 2, 3], [28, 29, 30, 31]]
    with pytest.raises(IndexError):
        s.sequence(17)


def test_sequences_are_views_of_equal_length(tmp_path):
    fs, root = tf.file_system(f"file://{tmp_path}")
    w = tf.ShardWriter(fs, f"{root}/s", 8, "<u2")
    ids = np.arange(8 * tf.BATCH_SEQS + 21, dtype="<u2")
    w.add(1, ids[:30].tobytes())
    w.add(2, ids[30:].tobytes())
    w.close()
    s = tf.TokenShard(f"file://{tmp_path}/s")
    assert len(s) == tf.BATCH_SEQS + 3 and s.sequence(tf.BATCH_SEQS)[0].tolist() == ids[8 * tf.BATCH_SEQS :][:8].tolist()
    first, mask = s.sequence(len(s) - 1)
    assert mask.to_pylist() == [True] * 5 + [False] * 3 and not first.flags.owndata
    assert s.ids(30, len(ids) - 30).tolist() == ids[30:].tolist()


ODD = chat.ADDED + [(1, 0, "system", "a\\b<s><</SYS>>"), (1, 1, "user", "\n<|end|>\n<|turn|>x"), (1, 2, "assistant", "</s"), (1, 3, "assistant", ""), (1, 4, "assistant", "\\"), (2, None, None, None), (2, 0, "tool\nname", "é😀"), (None, 1, "user", "lost"), (3, 0, "assistant", "abc\n")]


def test_chat_digests(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in ODD}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in ODD if r[0] == c])
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb"]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "x", "\n", "/s>"]), max_size=6).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    r = chat.render(turns)
    assert chat.read_back(r.text) == turns and not r.rewrites
    assert [chat.unescape(r.text[a:b]) for a, b in r.texts] == [t for _, t in turns]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_rewriting_templates_are_noticed():
    def forgetful(turns, coming=None):  # only the last two turns are shown
        return "|".join(t for _, t in turns[-2:])

    r = chat.render([("user", "a"), ("assistant", "b"), ("user", "c")], forgetful)
    assert r.rewrites and r.turns[2] is None and r.turns[0] == (0, 1)


def test_templates_that_append_give_what_prefixes_give():
    import random

    rng = random.Random(2)
    both = chat.AppendTemplate(lambda r, t: chat.marked_template([(r, t)]), lambda r: chat.marked_template([], r))
    odd = chat.AppendTemplate(lambda r, t: t.upper() + r, lambda r: "?")
    for n in (0, 1, 7, 40):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["", "x", "</s>", "a\\b\n"])) for _ in range(n)]
        for template, plain in ((both, chat.marked_template), (odd, lambda t, c=None: odd(t, c))):
            a, b = chat.render(turns, template), chat.render(turns, plain)
            assert (a.text, a.turns, a.texts, a.rewrites) == (b.text, b.turns, b.texts, b.rewrites)


def test_tiling_catches_reordered_passages(spark):
    item = "one two three four five six. Seven eight nine ten eleven twelve!"
    docs = [(1, f"x y {item} z"), (2, "Seven eight, nine ten eleven twelve and then one two THREE four five six"), (3, "one two three four five and no more"), (4, None), (5, ""), (6, "hi there"), (7, item + " " + "pad " * 50_000), (None, item)]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, "hi there"), (12, None), (13, "..."), (14, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tiles"], r["coverage"]) for r in contamination(df, bench).collect()}
    assert got == {(d, i): ((2 if d == 2 else 1), 1.0) for d in (1, 2, 7, None) for i in (10, 14)} | {(6, 11): (1, 1.0)}
    assert sorted(r["doc_id"] for r in decontaminate(df, bench).collect()) == [3, 4, 5] and decontaminate(df, bench).columns == df.columns
    assert contamination(df, bench.limit(0)).count() == 0 and contamination(df.limit(0), bench).count() == 0


def plain_tiles(a, b, least):
    """Greedy tiling by its definition."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        out.append((i, j, n))
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=18))
def test_tiles_match_the_definition(a, b):
    pairs = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
    assert tile(len(a), iter(pairs), 3) == plain_tiles(a, b, 3)


def plain_contamination(docs, items, seed=5, coverage=0.8):
    """Every document against every item by the definition of greedy tiling."""
    import re

    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        for k, item in items:
            a, b = words(item), words(t)
            tiles = plain_tiles(a, b, min(seed, len(a))) if a else []
            total = sum(x[2] for x in tiles)
            if tiles and total >= coverage * len(a) - 1e-9:
                out.append((d, k, len(a), total, len(tiles), max(x[2] for x in tiles)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark, monkeypatch):
    import random

    from tidewire.llm import decontaminate as dc

    rng = random.Random(4)
    draw = lambda n, m: [rng.choice([f"w{k}" for k in range(m)] + ["É", "Ab", "ab"]) for _ in range(n)]
    items = [(k, " ".join(draw(rng.choice([1, 3, 4, 5, 6, 9, 17, 30]), 6 if k % 2 else 60))) for k in range(24)] + [(24, None), (25, ""), (26, "a a a a a a a a"), (26, "a a a a a a a a"), (None, "x y z x y z x y")]
    docs = []
    for k in range(60):
        parts = [" ".join(draw(rng.randrange(0, 12), 6))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "q").split()
            cut = rng.randrange(len(w) + 1)
            parts += [" ".join(w[cut:]).upper(), rng.choice(["", "then", "and so on"]), "-".join(w[:cut])]
        docs.append((k, ".\n".join(parts)))
    docs += [(100, "a " * 60), (101, "a " * 5), (102, "x y z " * 20), (103, None), (104, ""), (None, items[5][1]), (105, docs[3][1]), (105, docs[3][1])]
    want = plain_contamination(docs, items)
    assert len(want) > 30 and any(r[4] > 1 for r in want)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block, portion in ((100_000, 1 << 20), (7, 5)):
        monkeypatch.setattr(dc, "BLOCK_ITEMS", block)
        monkeypatch.setattr(dc, "PORTION", portion)
        assert sorted((tuple(r)[:6] for r in dc.contamination(df, bench).collect()), key=str) == want
        found = {r[0] for r in want}
        assert sorted((r["doc_id"] for r in dc.decontaminate(df, bench).collect()), key=str) == sorted((d for d, _ in docs if d not in found), key=str)


def test_repetitive_texts_cost_their_matches():
    import time

    from tidewire.llm.decontaminate import Seeds
    from tidewire.llm.wordhash import ALNUM, texts_words

    block = Seeds([1], ["the " * 200], 5)
    began = time.process_time()
    assert [x[:5] for x in block.covered(texts_words(["the " * 100_000], ALNUM)[0], 0.8)] == [(1, 200, 200, 1, 200)]
    assert time.process_time() - began < 20


def test_chance_of_a_fingerprint_does_not_count(monkeypatch):
    from tidewire.llm import decontaminate as dc
    from tidewire.llm.wordhash import ALNUM, texts_words

    block = dc.Seeds([1], ["one two three four five six"], 5)
    words = texts_words(["one two three four five six"], ALNUM)[0]
    assert len(list(block.covered(words, 0.8, "one two three four five six"))) == 1
    assert list(block.covered(words, 0.8, "six other words of equal prints")) == []


def plain_fit(pieces, capacity):
    """Best fit by its definition: of all bins with room and without conflict the fullest, then the oldest."""
    bins, out = [], []
    for n, s, c in pieces:
        ok = [(capacity - b["used"], k) for k, b in enumerate(bins) if b["used"] < capacity and capacity - b["used"] >= n and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"])]
        k = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append({"used": 0, "s": set(), "c": set()})
        out.append((k, bins[k]["used"]))
        bins[k]["used"] += n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(-1, 3), st.integers(-1, 4)), max_size=40))
def test_best_fit_matches_the_definition(pieces):
    pieces = sorted(pieces, key=lambda p: -p[0])
    assert packing.best_fit(*([p[k] for p in pieces] for k in range(3)), 10) == plain_fit(pieces, 10)


def test_packing_keeps_everything(spark):
    docs = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(500, "w " * 1234, None), (501, None, "a"), (502, "", None), (503, "same text", "b"), (504, "same text", "c")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, block long")
    rows = packing.pack(df, capacity=50, block_docs=64).collect()
    words = {i: len((t or "").split()) for i, t, _ in docs}
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    source = {i: s for i, _, s in docs}
    for i, own in by.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == words[i]
    assert set(by) == set(words) and all((r["bin_id"] is None) == (r["length"] == 0) for r in rows)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) <= 50
        assert all(source[a["doc_id"]] is None or source[a["doc_id"]] != source[b["doc_id"]] for a, b in combinations(own, 2))
    assert packing.pack(df.limit(0)).count() == 0


def test_bins_rebuild_every_document(spark):
    big = 9_007_199_254_740_993  # no float holds it
    docs = [(big, "w " * 130, "a"), (big + 2, " \t one  two\n three ", "a"), (None, "x y z", None), (None, "x y z", "b"), (7, "é\u00a0è " * 75, "c"), (7, "other text of this id", "c"), (8, None, "d"), (9, " \n ", "d"), (10, "", None)]
    df = spark.createDataFrame([(*d, "z", 1.5) for d in docs], "doc_id long, text string, source string, cluster string, length double")
    rows = packing.pack(df, capacity=50, block_docs=4).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    whole, texts = {}, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] or 0, r["piece"])):
        whole.setdefault((r["doc_id"], r["piece"]), []).append(r)
    by = {i: "".join(r["text"] for (j, _), rs in whole.items() if j == i for r in rs) for i in (big, big + 2, 8, 9, 10)}
    assert by == {i: t or "" for i, t, _ in docs if i in by}
    texts = sorted(r["text"] for r in rows if r["doc_id"] == 7)
    assert sorted(["é\u00a0è " * 50, "é\u00a0è " * 25, "other text of this id"]) == texts
    packed = packing.pack(df, capacity=50, block_docs=4)
    for b in packing.bins_of(packed).collect():
        assert b["length"] == sum(len(p["text"].split(" ")) - p["text"].endswith(" ") for p in b["pieces"] if p["doc_id"] != big + 2) + 3 * any(p["doc_id"] == big + 2 for p in b["pieces"]) <= 50
    fill = packing.fill_rate(packed, 50).first()
    assert fill["least_bins"] <= fill["bins"] and 0 < fill["fill"] <= 1
    assert packing.fill_rate(packing.pack(df.limit(0)), 50).first()["fill"] is None


def test_packing_of_odd_lengths_and_given_classes(spark):
    df = spark.createDataFrame([(i, "t", "s", None if i == 0 else -3 if i == 1 else 4, 1 if i < 6 else None) for i in range(12)], "doc_id long, text string, source string, n int, class int")
    from pyspark.sql import functions as F

    rows = packing.pack(df, capacity=10, length=F.col("n"), source_col=None, cluster=F.col("class")).collect()
    assert sorted(r["doc_id"] for r in rows if r["bin_id"] is None) == [0, 1] and all(r["text"] == "t" for r in rows)
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r["doc_id"])
    assert all(sum(i < 6 for i in own) <= 1 for own in bins.values()) and len(bins) == 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="cookie-notice">We use cookies to make this page better for you and for us.</div>
<div class="ad">Buy this long and wonderful product now, it is really very good for you.</div>
<article><h1>Short &amp; sweet</h1><p>First  paragraph<br>with   some <b>bold</b> words, and it goes on for a while to be long enough.<p>Second one, unclosed, also long enough to be taken for prose by any measure.
<aside>An aside that says something at length about something else entirely, really.</aside><form><p>Your mail <input name=q></p></form>
<section id="comments"><p>A reader comment that is as long as a paragraph and should not be here at all.</p></section></article>
<footer>&copy; Somebody 2024, all rights reserved, and some more words in the footer.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Short & sweet\nFirst paragraph with some bold words, and it goes on for a while to be long enough.\nSecond one, unclosed, also long enough to be taken for prose by any measure."
    assert html_text.main_text(PAGE.replace("article", "div")) == html_text.main_text(PAGE)
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "<p", "plain")] == ["", "", "", "", "plain"]


PROSE = "<h1>Title of it</h1><p>" + "A long sentence of real prose that goes on. " * 4 + "</p><p>Short.</p><p>" + "Another long one, of many words again and more. " * 4 + "</p>"
PROSE_TEXT = "\n".join(["Title of it", ("A long sentence of real prose that goes on. " * 4).strip(), "Short.", ("Another long one, of many words again and more. " * 4).strip()])
MENU = "<nav><a href=/>Home</a> <a href=/b>More</a></nav>"


@pytest.mark.parametrize("tag", ["div", "article", "section"])
@pytest.mark.parametrize("names", ["content with-sidebar", "post has-sidebar", "article comment-enabled", "entry share-buttons-on", "widget-area main-content", "nav-page", "page-sidebar", "sidebar"])
def test_names_of_wrappers_lose_nothing(tag, names):
    page = f"<html><body>{MENU}<{tag} class='{names}'>{PROSE}</{tag}><footer>&copy; me and all the others</footer></body></html>"
    assert html_text.main_text(page) == PROSE_TEXT


def test_articles_marks_and_broken_markup():
    text = html_text.main_text
    assert text(f"<article id='post-related-1'>{PROSE}</article>") == PROSE_TEXT
    assert text(f"<body>{MENU}<article>{PROSE}</article><article>{PROSE}</article></body>") == PROSE_TEXT + "\n" + PROSE_TEXT
    assert text("<article><p>Some <button>x</button> more <span hidden>gone</span><span class='ad'>buy</span> words.</p></article>") == "Some more words."
    assert text(f"<article>{PROSE}<![foo bar]><p>After it.</p></article><p class=") == PROSE_TEXT + "\nAfter it."
    assert text(f"<article>{PROSE}</article><!-- never ended") == PROSE_TEXT and text("a < b &amp c &lt; d") == "a < b & c < d"
    assert text(f"<form id=f><div class=sidebar><ul><li>x</li></ul></div><article>{PROSE}</article></form>") == PROSE_TEXT
    assert text(f"<div><ul><li><a>A1</a></li><li><a>A2</a></li><li><a>A3</a></li></ul>{PROSE}</div>") == PROSE_TEXT
    reader = f"<p>{'words of a reader. ' * 60}</p>"
    for comments in (f"<div id=comments>{reader}</div>", f"<div id=comments><article class=comment>{reader}</article></div>", f"<article class='comment-body'>{reader}</article>", f"<form>{reader}</form>", f"<div role=complementary>{reader[:200]}</div>"):
        assert text(f"<article>{PROSE}</article>{comments}") == PROSE_TEXT
        assert text(f"<div>{PROSE}{comments}</div>") == PROSE_TEXT


def test_deep_and_long_pages():
    deep = "<div><p>" * 30_000 + "words in the deep " * 5 + "</i></q>" * 30_000
    assert html_text.main_text(deep) == ("words in the deep " * 5).strip()
    assert len(html_text.main_text("<p>one line of many words in it.</p>" * 20_000).split("\n")) == 20_000


def test_pages_match_the_sql(spark):
    """On the pages of the tables, which have one plain article each, regular expressions find the same."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    if not __import__("os").path.exists(f"{folder}/pages.parquet"):
        pytest.skip("tables are not there")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(html_text.OP8_SQL).fetchall()}
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.op8_html_text(spark, folder).collect()}
    assert got == want and len(got) > 100


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "v", "<p>" + "long text " * 20_000, "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == 4 and sorted(r["n_chars"] for r in rows)[:2] == [0, 0] and max(r["n_chars"] for r in rows) == 199_999
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def toxic_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words, bad = [f"{a}{b}{c}" for a in ("ba", "ri", "mo", "ten") for b in ("lo", "ka", "shi") for c in ("n", "der", "ma", "st")], ["grumbold", "snarkwit", "vilefoo"]
    for i in range(n):
        y = int(i % 4 == 0)
        text = [str(rng.choice(words)) for _ in range(int(rng.integers(12, 200)))]
        for _ in range(max(1, len(text) // 25) * y):
            b = str(rng.choice(bad))
            text[int(rng.integers(len(text)))] = b if i % 3 else b[:4] + "x" + b[4:]
        yield i, " ".join(text), y


def test_toxicity_learns_what_it_has_not_seen(spark):
    rows = list(toxic_rows())
    docs = spark.createDataFrame([(i, t, 0.5, "hot") for i, t, _ in rows] + [(None, "x", 0.1, "s"), (9001, None, 0.1, "s"), (9002, "", 0.1, "s")], "doc_id long, text string, score double, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and len(held) > 50
    assert np.mean([p == y for p, y in held]) > 0.93
    assert got[9001]["score"] == got[9002]["score"] and 0 <= got[9001]["score"] <= 1 and got[None]["held_out"] is None
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    assert toxicity.fit([], []).score("x") < 0.5 and toxicity.fit(["a"], [1]).score("b") > 0.5
    texts, ys = toxicity.training_rows(docs, labels, rows=50)
    assert len(texts) == len(ys) == 50


def plain_toxicity(texts, labels):
    """The fit by dense matrices, one loop a definition."""
    from tidewire.llm import toxicity_model as tm

    y, rng = np.array(labels), np.random.default_rng(tm.SEED)
    mixed = rng.permutation(len(texts))
    grams = [tm.subwords(t) for t in texts]
    used = sorted({int(g) for own in grams for g in own})
    column = {g: k for k, g in enumerate(used)}
    x = np.zeros((len(texts), len(used)))
    for i, own in enumerate(grams):
        for g in own:
            x[i, column[int(g)]] += 1
    holders = (x > 0).sum(axis=0)
    size, squares = x.sum(axis=1), (x * x).sum(axis=1)
    effective = np.divide(size**2, squares, out=np.zeros(len(texts)), where=squares > 0)
    x = x / np.maximum(size, 1)[:, None] * (tm.SCALE * effective / (effective + tm.NEUTRAL))[:, None]
    x[:, holders < min(tm.MIN_DOCS, -(-len(texts) // 100))] = 0
    v = rng.normal(0, 0.05, (tm.BUCKETS, tm.DIM))[used]
    w, b = rng.normal(0, 0.5, (tm.DIM, 2)), np.log([1 - y.mean(), y.mean()])
    parts = [mixed[k : k + tm.BATCH] for k in range(0, len(texts), tm.BATCH)]
    epochs = max(tm.EPOCHS, -(-tm.LEAST_STEPS // len(parts)))
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            own = parts[k]
            z = x[own] @ v
            e = np.exp(z @ w + b)
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= np.where(y[own] > 0, tm.POSITIVE, 1.0)[:, None] / len(own)
            rate = tm.RATE * (1 - step / (epochs * len(parts)))
            step += 1
            moves = [x[own].T @ (p @ w.T), z.T @ p, p.sum(axis=0)]
            for value, g in zip((v, w, b), moves, strict=True):
                value -= rate * min(1.0, tm.CLIP / (np.sqrt((g * g).sum()) + 1e-12)) * g
    return lambda i: 1 / (1 + np.exp(-(x[i] @ v @ (w[:, 1] - w[:, 0]) + b[1] - b[0])))


def test_the_fit_matches_dense_matrices():
    rows = list(toxic_rows(150))
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    model, plain = toxicity.fit(texts, labels), plain_toxicity(texts, labels)
    assert max(abs(model.score(t) - plain(i)) for i, t in enumerate(texts)) < 0.01
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True)]) > 0.9


def test_toxicity_of_few_long_and_repeated_texts(spark):
    rows = list(toxic_rows(60))
    few = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert len({round(few.score(t), 6) for _, t, _ in rows}) > 30  # few labels are still no constant
    long = rows[0][1] + " " + "ba " * 400_000
    df = spark.createDataFrame([(1, long), (2, rows[0][1]), (2, rows[0][1]), (None, None)], "doc_id long, text string")
    got = [r["score"] for r in toxicity.toxicity_scores(df, few).orderBy("doc_id").collect()]
    assert got[2] == got[3] == few.score(rows[0][1]) and got[1] == few.score(long) and got[0] == few.score("")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 7), (None, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    assert toxicity.drop_toxic(df, labels.limit(0)).count() == 4 and toxicity.drop_toxic(df.limit(0), labels).count() == 0


def test_the_sample_ends_at_its_bound():
    sample = [(0, 1, 1, "a" * 10), (1, 2, 0, "b" * 30), (2, 3, 0, "c")]
    assert toxicity.within_bound(iter(sample), 45) == (["a" * 10, "b" * 30, "c"], [1, 0, 0])
    assert toxicity.within_bound(iter(sample), 39) == (["a" * 10], [1])
