"""Training-data operators against brute force on small tables, and their defined cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from suasion.llm import bpe, decontaminate, html_text, line_dedup, lz_fingerprint, quality, rollups, shared, simhash, token_files, toxicity
from suasion.llm.components import components
from suasion.llm.queries import REGISTRY
from suasion.llm.shared import fold, ready
from suasion.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD2 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD6 = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " ", "\n\n", "one", "Don't STOP!! it's 12,5% — naïve Ünïcödé ça\tva  \n\n x", "a" * 3000, "ﬁ İ ǅ é é ½ ² ª",
       "日本語 テキスト 😀😀 ​\xa0x", "w " * 3000, "<|endoftext|> <|startoftext|>", "a<|endoftext|>b it's <|ENDOFTEXT|>", "é<|startoftext|>é<|endoftext|>\n<|endoftext|>x", "aaa bbb ccc ddd eee", "\x1c\x85   y", "' 's ''s"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


@pytest.fixture(scope="module")
def docs(sp):
    return sp.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


def run(sp, key):
    return REGISTRY[key][0](sp, SF)


# 1 ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected_files(tok, pairs):
    at, out = 0, []
    for i, t in pairs:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query(sp, rows, word_tokenizer):
    got = [tuple(r) for r in run(sp, "op1_token_files").collect()]
    assert sorted(got) == expected_files(word_tokenizer, rows)


def test_token_files_odd_texts(sp, word_tokenizer):
    docs = frame(sp, ODD).withColumn("ids", F.lit("clash")).withColumn("start", F.lit(1))
    manifest, uri = token_files.token_files(sp, docs, P.path("word_bpe_49k.json"), 1, 49_408)
    got = token_files.read_token_files(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == expected_files(word_tokenizer, list(enumerate(ODD)))


def test_token_files_ties_nulls_and_empty(sp):
    docs = frame(sp, ["b c", "a", "x y z", "a"], [7, None, 7, 7])
    manifest, uri = token_files.token_files(sp, docs, P.path("word_bpe_49k.json"), 1, 49_408)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(manifest, uri).collect())
    assert got[0] == (0, None, 2) and [g[1] for g in got[1:]] == [7, 7, 7]
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    manifest, uri = token_files.token_files(sp, docs.limit(0), P.path("word_bpe_49k.json"), 1, 49_408)
    assert token_files.read_token_files(manifest, uri).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "a", " ", "\n", "é", "<|", "'s"]), max_size=9).map("".join)))
def test_word_chunks_equal_library(word_tokenizer, text):
    table, added = token_files._table(P.path("word_bpe_49k.json"))
    flat, _ = table.ids([token_files._chunks(text, added)])
    assert flat.tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids


# 2 ---------------------------------------------------------------------------------
def brute_decontaminate(pairs, items, window=10):
    by_len = {}
    for i, t in items:
        w = WORD2.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else []:
            by_len.setdefault(n, {}).setdefault(tuple(w[k:k + n]), set()).add(i)
    for d, t in pairs:
        w = WORD2.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n, m in by_len.items():
            for k in range(len(w) - n + 1):
                if (z := m.get(tuple(w[k:k + n]))):
                    found |= z
                    hit[k:k + n] = [1] * n
        yield (d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), sum(hit) > 0)


def test_decontamination_query(sp, rows):
    items = [tuple(r) for r in sp.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in run(sp, "op2_decontamination").collect())
    assert got == list(brute_decontaminate(rows, items))
    assert any(r[-1] for r in got)


def test_decontamination_small_vocabulary(sp, monkeypatch):
    """Few words, so windows overlap, repeat and share terms; several segments and item blocks."""
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 40)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 20)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["", None, "Z", "a b a"]
    items = [(1, "a b a b"), (2, "b"), (3, ""), (4, None), (5, "a a a b b a a"), (5, "b b b"), (9, "q r s")]
    docs = frame(sp, texts).withColumn("n_words", F.lit("clash"))
    index = decontaminate.build_index(docs)
    bench = sp.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(index, decontaminate.phrase_matches(index, bench, 3))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
                  r["contaminated"]) for r in got.collect())
    assert got == list(brute_decontaminate(list(enumerate(texts)), items, 3))
    clean = decontaminate.without_contaminated(docs, bench, 3)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in got if not r[-1]}


def test_decontamination_empty(sp):
    docs, none = frame(sp, ["a b"]), sp.createDataFrame([], "item_id long, text string")
    index = decontaminate.build_index(docs)
    assert [r["n_hit"] for r in decontaminate.contamination(index, decontaminate.phrase_matches(index, none)).collect()] == [0]
    index = decontaminate.build_index(docs.limit(0))
    some = sp.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(index, decontaminate.phrase_matches(index, some)).count() == 0


def test_proximity(sp):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 25))) for _ in range(80)]
    items = [(1, "a b c"), (2, "h a"), (3, "zz a")]
    index = decontaminate.build_index(frame(sp, texts))
    found = decontaminate.proximity_matches(index, sp.createDataFrame(items, "item_id long, text string"), 1)
    ids = decontaminate.indexed_documents(index)
    got = {(r["doc_id"], r["item_id"]) for r in found.join(ids, ["segment", "place"]).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for i, q in items:
            size = len(q.split()) + 1
            if any(set(q.split()) <= set(w[k:k + size]) for k in range(len(w))):
                want.add((d, i))
    assert got == want and want


# 3 ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_encoding():
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_bpe(enc, pairs):
    for d, t in pairs:
        ids = np.asarray(enc.encode_ordinary(t or ""), "<u4")
        yield d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_query(sp, rows, byte_encoding):
    assert sorted(tuple(r) for r in run(sp, "op3_bpe").collect()) == list(expected_bpe(byte_encoding, rows))


def test_bpe_odd_texts_and_round_trip(sp, byte_encoding):
    docs = frame(sp, ODD).withColumn("ids", F.lit("clash"))
    path = P.path("byte_bpe_50k.tiktoken")
    assert sorted(tuple(r) for r in bpe.digests(docs, path, P.PATTERN).collect()) == list(expected_bpe(byte_encoding, enumerate(ODD)))
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab c'\n", max_size=60)))
def test_bpe_equals_tiktoken(byte_encoding, text):
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert codec.encode([text])[0].tolist() == byte_encoding.encode_ordinary(text)


def test_merge_replay_with_lower_rank_later():
    """A merge whose result pairs to a token of LOWER rank: that one goes first."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 5, b"ab": 9, b"bc": 20, b"abcabc": 7, b"ca": 6}
    enc = bpe.Codec(ranks, r"\w+")
    import tiktoken
    ref = tiktoken.Encoding("x", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for t in ["abc", "abcabc", "ababc", "cabcab", "aabbcc", "abcabcabc", "bcabca"]:
        assert enc.encode([t])[0].tolist() == ref.encode_ordinary(t), t


def test_texts_longer_than_a_piece(monkeypatch, byte_encoding, word_tokenizer):
    import functools

    from suasion.llm import chunks
    small = functools.partial(chunks.pieces, size=50)
    monkeypatch.setattr(bpe, "pieces", small)
    text = " ".join(random.Random(1).choice(["foo", "bar,", "don't", "x\n\ny", "  z"]) for _ in range(300))
    assert bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode([text])[0].tolist() == byte_encoding.encode_ordinary(text)
    table, added = token_files._table(P.path("word_bpe_49k.json"))
    lists = [token_files._chunks(p, added) for p in small(text, token_files._SPACE)]
    flat, _ = table.ids(lists)
    assert flat.tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids


# 4, 9 ------------------------------------------------------------------------------
def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])


@pytest.mark.parametrize(("key", "label", "mod", "held", "least"), [("op4_quality", "quality", 5, 0, 0.9), ("op9_toxicity", "toxic", 3, 1, 0.75)])
def test_held_out_accuracy(sp, key, label, mod, held, least):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in REGISTRY[key][0](sp, sf).collect()}
    labels = {r["doc_id"]: r[label] for r in sp.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % mod == held) for d, r in got.items())
    assert auc([(got[d]["score"], y) for d, y in labels.items() if got[d]["held_out"]]) > least


def test_toxicity_learns_a_pair(sp):
    """Insult and group mention each alone are harmless: only their product tells."""
    rnd = random.Random(2)
    fill = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows = []
    for i in range(800):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words = rnd.sample(fill, 12) + ["oaf"] * insult + ["folk"] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    docs = sp.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "toxic")
    tests = frame(sp, ["oaf waa", "folk waa", "folk waa oaf", "waa wbb", "", None]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["s"] for r in tests.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert got[2] > 0.7 and max(got[0], got[1], got[3], got[4], got[5]) < 0.5
    kept = toxicity.without_toxic(tests, model)
    assert kept.columns == tests.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 3, 4, 5}


def test_toxicity_counts_occurrences(sp):
    """Every text has the marked word: once in clean ones, three times in toxic ones."""
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(60)] + ["oaf"] * (3 if i % 4 == 0 else 1)
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = sp.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), docs.where("doc_id < 300"), "toxic")
    got = docs.where("doc_id >= 300").select("toxic", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == 100 and all((r["s"] >= 0.7) == (r["toxic"] == 1) for r in got)


def test_labelled_sample_has_one_text_per_id(sp):
    """One labelled id on most rows: the sample holds each id once, whatever the order of the rows."""
    texts = [f"copy {i}" for i in range(50)] + ["b", None, "c"]
    docs = frame(sp, texts, [1] * 50 + [2, 3, 4])
    labels = sp.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, toxic int")
    got = shared.labelled_texts(docs, labels, F.col("toxic"), "doc_id", "text", 100).collect()
    low = min(((r["h"], r["text"]) for r in docs.where("doc_id = 1").select(F.xxhash64("text").alias("h"), "text").collect()))[1]
    assert sorted(map(tuple, got)) == [(0, ""), (0, "b"), (1, low)]
    machine = toxicity.fit(docs, labels.where("toxic = 1"), "toxic")
    assert machine.bias == pytest.approx(np.log(1.5 / 0.5))


def test_classifiers_without_labels(sp):
    docs = frame(sp, ["a b", "", None]).withColumn("__x", F.lit(1))
    none = sp.createDataFrame([(None, 1, None), (0, None, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").where("false")
    machine = toxicity.fit(docs, none, "toxic")
    assert {r[0] for r in docs.select(toxicity.score(machine, F.col("text"))).collect()} == {0.5}
    rules = quality.fit(docs, none)
    assert {r["score"] for r in quality.scored(docs.withColumn("score", F.lit("clash")), rules).collect()} == {0.5}
    assert quality.scored(docs.limit(0), rules).count() == 0


def test_rules_compile_to_what_they_mean():
    rule = quality._shortest(((0, 3.0, True), (0, 2.0, True), (1, 5.0, False), (1, 7.0, False)))
    assert rule == ((0, 2.0, True), (1, 7.0, False))


def test_statistics_of_odd_texts():
    for t in ODD:
        s = quality.statistics(t or "")
        assert len(s) == len(quality.STATS) and all(np.isfinite(s))


# 5 ---------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site">Site name</header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept them all now.</div><!-- <p>no</p> -->
<article><h1>A &amp; B</h1><p>First <b>para</b>graph with&nbsp;some
   words &lt;here&gt;.<p>Two.</p><div class="ad">Buy now!</div><script>var t="</p><p>x</p>";</script>
<p title="a > b">Third one is a longer paragraph with <a href="#">a link</a> inside it.</p><form>Name <input></form></article>
<aside>Related things you may like to read.</aside><section id="comments"><article class="comment"><p>Great post, thanks!</p></article></section>
<footer>&copy; nobody</footer>"""


@pytest.fixture(scope="module")
def tree(sp):
    return html_text.fit(sp)


def test_html_page(tree):
    assert html_text.main_text(PAGE, tree) == ("A & B\n\nFirst paragraph with some words <here>.\n\nTwo.\n\n"
                                               "Third one is a longer paragraph with a link inside it.")


def test_html_without_article_tags(tree):
    para = " ".join(["word"] * 60)
    page = f"<div><a href=1>Home</a></div><div><a href=2>About us</a></div><div>{para}</div><div>{para}</div><div>x <a>y</a></div>"
    assert html_text.main_text(page, tree) == f"{para}\n\n{para}"


def test_html_tree_fits_its_table(tree):
    assert all((html_text.share(tree, r[:-1]) > 0.5) == (r[-1] == 1) for r in html_text.LABELLED)
    assert len(html_text.LABELLED) < 200


def test_html_odd_pages(sp, tree):
    pages = ["", None, "plain", "<", "<p", "<article><p>unclosed <b>bold", "<a href=\"x>y", "<p>" * 2000, "<script>", "a<!-- b", '"' * 5000 + "<p '"]
    rows = sp.createDataFrame([(i, None, p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(rows, tree).collect()}
    assert len(got) == len(pages) and got[0]["text"] == got[1]["text"] == "" and got[5]["text"] == "unclosed bold"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(rows.limit(0), tree).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p>One.</p><svg class="i"/><p>Two two.</p><p>Three.</p></article>', ["One.", "Two two.", "Three."]),
    ("<article><p>One <button>x</p><p>Two</p><div><select><option>q</div><p>Three</p></article>", ["One", "Two", "Three"]),
    ("<article><div><iframe src='a'></div><p>One</p><div><object></div><p>Two</p></article><textarea>a</p></article>b</textarea>", ["One", "Two"]),
    ("<article><p>One <svg><g><text>no</text></g></svg>end</p><p>Two</p></article>", ["One end", "Two"]),
    ('<article><p>One <span class="sponsored">Buy <span>now</span> it</span> end</p><p class="ad">Ad</p><p>Two <b hidden>no</b></p></article>', ["One end", "Two"]),
    ('<article><p>One <span class="ad">unclosed</p><p>Two</p><p class="promo">Ad<p>Three</article>', ["One", "Two", "Three"])])
def test_html_unclosed_and_hinted_elements(tree, page, want):
    assert html_text.main_text(page, tree) == "\n\n".join(want)


def test_html_query_drops_furniture(sp):
    got = run(sp, "op5_html_text").collect()
    pages = {r["page_id"]: r["html"] for r in sp.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    import html as h
    for r in got:
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        want = [" ".join(h.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in want if x)


# 6 ---------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = WORD6.findall((text or "").translate(LOWER))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    f = np.array(fps, np.uint64)
    up = list(range(len(f)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_simhash_query(sp, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(sp, "op6_simhash").collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    assert got == {d: (f"{fps[i]:016x}", rows[roots[i]][0]) for i, (d, _) in enumerate(rows)}


def test_simhash_odd_texts_ids_and_stage(sp):
    texts = [*ODD, *ODD, "aaa bbb ccc ddd eee"]
    docs = frame(sp, texts, [*range(len(ODD)), *range(len(ODD)), None]).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs)
    assert got.count() == len(texts)
    for r in got.collect():
        if r["doc_id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(ODD[r["doc_id"]])
    fps = [brute_fingerprint(t) for t in ODD]
    roots = brute_components(fps)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_gray_index_finds_every_link():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 600, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64))
    dense = base[0] ^ rnd.integers(0, 64, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([base, near, dense]))

    def rank(v):
        for s in (1, 2, 4, 8, 16, 32):
            v = v ^ (v >> np.uint64(s))
        return v
    x = x[np.argsort(rank(x))]
    want = brute_components(x.tolist())
    assert simhash.linked(x, x, True).tolist() == want
    a, b = x[:500], x[500:]
    both = simhash.linked(a, b, False)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 3):
            assert both[i] == both[len(a) + j]


def test_simhash_links_over_many_blocks(sp, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(400)]
    fps = sorted({*base, *(b ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63) for b in base[:150])})
    edges = simhash.links(sp.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in fps])
    groups, mine = {}, {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(f)
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], [], [(3, 3)],
                                   [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(45)]])
def test_components(sp, edges):
    got = {r["node"]: r["component"] for r in components(sp.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert {k: got.get(k, k) for k in up} == up


# 7 ---------------------------------------------------------------------------------
def test_rollup_batches(sp):
    root = scratch_path(sp, "rollup-test")

    def ch(rows):
        return sp.createDataFrame(rows, rollups.CHANGES)

    def now():
        return sorted(((r["source"] or "-", r["lang"], r["tokenizer_version"], r["n_docs"], r["n_tokens"], r["n_chars"])
                       for r in rollups.totals(sp, root).collect()))
    first = ch([("insert", 1, "s", "en", "v1", 5, 20), ("insert", 2, "s", "en", "v1", 7, 30), ("insert", None, None, "en", "v1", None, 1)])
    assert rollups.commit(sp, root, "a", first) and not rollups.commit(sp, root, "a", first)
    assert now() == [("-", "en", "v1", 1, 0, 1), ("s", "en", "v1", 2, 12, 50)]
    rollups.compact(sp, root)
    second = ch([("revise", 1, "t", "en", "v1", 4, 19), ("delete", None, None, None, "v1", 0, 0), ("delete", 9, "s", "en", "v1", 3, 3),
                 ("revise", 8, "s", "en", "v2", 2, 2)])
    assert rollups.commit(sp, root, "b", second)
    want = [("s", "en", "v1", 1, 7, 30), ("s", "en", "v2", 1, 2, 2), ("t", "en", "v1", 1, 4, 19)]
    assert now() == want
    rollups.compact(sp, root)
    assert not rollups.commit(sp, root, "b", second) and rollups.commit(sp, root, "c", ch([]))
    assert now() == want and rollups.batches(sp, root) == ["a", "b", "c"]


def test_rollup_query(sp):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    fn, sql = REGISTRY["op7_token_counts"]
    df = fn(sp, SF)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())


def test_rollup_query_null_and_repeated_ids(sp, tmp_path):
    """Null ids with a unique text stay, one row of each text stays, whatever its id."""
    import duckdb
    rows = [(None, "only a"), (None, "only b b"), (1, "x y\nx y"), (None, "x y\nx y"), (2, "same one"), (2, "same one"),
            (2, "other text here"), (3, "x y\nx y"), (4, None), (None, ""), (5, "l\nl\nm"), (5, "l\nl\nm")]
    sp.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    fn, sql = REGISTRY["op7_token_counts"]
    rel = con.sql(sql)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(map(str, (tuple(r) for r in fn(sp, str(tmp_path)).select(*rel.columns).collect()))) == want


# 8 ---------------------------------------------------------------------------------
def brute_lines(pairs, min_words=5):
    seen, drop = [], {}
    first = {}
    for d, t in pairs:
        for i, line in enumerate((t or "").split("\n")):
            w = tuple(line.split())
            if not w:
                continue
            if w in first:
                drop.setdefault(d, set()).add(i)
                if first[w]:
                    drop[d].add(i)
                continue
            near = any(max(len(w), len(x)) >= min_words and line_dedup.distance_one(list(x), list(w)) for x in seen)
            first[w] = near
            seen.append(w)
            if near:
                drop.setdefault(d, set()).add(i)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in drop.get(d, ())) for d, t in pairs}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.sampled_from("ab"), max_size=6), st.lists(st.sampled_from("ab"), max_size=6))
def test_distance_one(a, b):
    assert line_dedup.distance_one(a, b) == (edit_distance(a, b) <= 1)


def test_line_dedup_query(sp, rows):
    got = {r["doc_id"]: (r["n_lines"], r["n_chars_left"], r["text_sha256"]) for r in run(sp, "op8_line_dedup").collect()}
    want = brute_lines(rows)
    assert got == {d: (len(t.split("\n")), len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in want.items()}


def test_line_dedup_small_vocabulary(sp):
    """Words from a small set: runs of equal words, insertions, replacements and shared variants abound."""
    rnd = random.Random(11)
    texts = ["\n".join(" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(0, 5))) for _ in range(120)]
    texts += ["", None, "  \n\n", "x y  z", "x y z", "\na b c d e f g h i"]
    docs = frame(sp, texts).withColumn("line", F.lit("clash")).withColumn("h1", F.lit(1))
    out = line_dedup.without_duplicate_lines(docs, count_col="n_chars")
    assert out.columns == docs.columns
    want = brute_lines(list(enumerate(texts)))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    for d, t in enumerate(texts):
        assert (got[d][0] or "") == want[d], d
        assert got[d][1] == (None if t is None else len(want[d]))


def test_line_dedup_null_and_repeated_ids(sp):
    docs = frame(sp, ["same line here", "same line here", "same line here", "other"], [5, 5, None, None])
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in line_dedup.without_duplicate_lines(docs).collect()))
    assert got == [(-1, "other"), (-1, "same line here"), (5, ""), (5, "")]
    assert line_dedup.without_duplicate_lines(docs.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------------
def brute_phrases(text):
    known, i = set(), 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        if j > len(text):
            break
        known.add(text[i:j])
        i = j
    return known


@given(st.text("abc", max_size=60), st.text("abc", max_size=20))
def test_lz_parse(text, after):
    own, edited = lz_fingerprint.phrases(text, after)
    q = len(text) // 4
    other = text[:len(text) - q] + after[:q]
    assert len(own) == len(set(own)) == len(brute_phrases(text)) and len(edited) == len(brute_phrases(other))
    assert own == lz_fingerprint.phrases(text)[0] and edited == lz_fingerprint.phrases(other)[0]


def lz_expected(pairs):
    out = {}
    for i, (d, t) in enumerate(pairs):
        n = pairs[(i + 1) % len(pairs)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + n[:q]
        s = lz_fingerprint.signatures([lz_fingerprint.phrases(x)[0] for x in (t, e, n)])
        near = [float(lz_fingerprint.likeness(s[:1], s[k:k + 1])[0]) for k in (1, 2)]
        hexes = [s[k].astype("<u2").tobytes().hex() for k in (0, 1)]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), *hexes, *near)
    return out


def test_lz_query(sp, rows):
    got = {r[0]: tuple(r[1:]) for r in run(sp, "op10_lz_fingerprint").collect()}
    assert got == lz_expected(rows)
    assert np.mean([g[-2] > g[-1] for g in got.values()]) > 0.9


def test_lz_likeness_follows_phrase_jaccard(rows):
    texts = [t for _, t in rows if len(t) > 300][:40]
    s = lz_fingerprint.signatures([lz_fingerprint.phrases(t)[0] for t in texts])
    p = [brute_phrases(t) for t in texts]
    errors = [float(lz_fingerprint.likeness(s[i:i + 1], s[j:j + 1])[0]) - len(p[i] & p[j]) / len(p[i] | p[j])
              for i in range(len(p)) for j in range(i)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_lz_odd_texts(sp):
    docs = frame(sp, ODD).withColumn("near_next", F.lit("clash"))
    got = {r[0]: (*r[1:3], bytes(r[3]).hex(), bytes(r[4]).hex(), *r[5:]) for r in lz_fingerprint.edited_likeness(docs).collect()}
    assert got == lz_expected([(i, t or "") for i, t in enumerate(ODD)])
    one = lz_fingerprint.edited_likeness(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert lz_fingerprint.edited_likeness(docs.limit(0)).count() == 0
    twins = lz_fingerprint.edited_likeness(frame(sp, ["abc abd", None, "abc abd"], [None, 1, 1])).collect()
    assert len(twins) == 3


# pipeline --------------------------------------------------------------------------
def test_pipeline(sp, docs, rows, byte_encoding):
    import corpus_pipeline as cp
    got = sorted(tuple(r) for r in cp.run(sp, SF).collect())
    labels = sp.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels, "toxic")
    of = toxicity._Terms({t: i for i, t in enumerate(model.terms)})
    score = model.scores([list(of.of(t)) for _, t in rows])
    left = [r for r, s in zip(rows, score, strict=True) if s < 0.7]
    left = sorted(brute_lines(left).items())
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    left = [r for i, r in enumerate(left) if roots[i] == i]
    items = [tuple(r) for r in sp.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_decontaminate(left, items) if r[-1]}
    left = [r for r in left if r[0] not in bad]
    assert got == list(expected_bpe(byte_encoding, left))
    assert 0 < len(got) < len(rows)


def test_pipeline_stages_on_empty_and_odd_documents(sp):
    import corpus_pipeline as cp
    for docs in (frame(sp, ODD).withColumn("text_hash", F.lit("x")), frame(sp, ["a"]).limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(sp, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        cp.STAGES[-1][1](sp, docs, SF).collect()


def test_shards_ascend_and_split_a_hot_id(sp):
    rnd = np.random.default_rng(1)
    ids = np.r_[np.full(400, 7), rnd.integers(0, 1000, 600), np.full(200, -(1 << 63))]
    ties = rnd.integers(-(1 << 63), (1 << 63) - 1, len(ids))
    rows = [(None if i == -(1 << 63) else int(i), "x") for i in ids]
    bounds = token_files.shard_bounds(sp.createDataFrame(rows, "doc_id long, text string"), 12)
    shard = token_files.shard_of(ids, ties, bounds)
    assert len(bounds) == 11 and shard.min() >= 0 and shard.max() <= 11 and np.bincount(shard, minlength=12).max() <= 200  # at most two parts' worth
    order = np.lexsort((ties, ids))
    assert (np.diff(shard[order]) >= 0).all()
    assert token_files.shard_of(ids, ties, []).max() == 0


def test_token_files_over_many_shards_with_a_hot_id(sp, word_tokenizer):
    texts = [f"w{i} x" for i in range(120)]
    docs = frame(sp, texts, [5 if i % 3 == 0 else None if i % 7 == 0 else i for i in range(120)])
    manifest, uri = token_files.token_files(sp, docs, P.path("word_bpe_49k.json"), 1, 49_408)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(manifest, uri).collect())
    keys = [-1 if g[1] is None else g[1] for g in got]
    assert len(got) == 120 and keys == sorted(keys)
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    assert sum(r["documents"] > 0 for r in manifest.collect()) > 4


def test_line_variants_of_a_long_line_cost_one_step_each():
    import time
    words = [f"w{i % 977}" for i in range(1_000_000)]
    began = time.time()
    hashes, places = line_dedup._variants(words, 1, 1)
    assert time.time() - began < 20 and len(hashes) == len(words) + 1 and places[0] == -1
    short = words[:7]
    whole = {tuple(short[:p] + short[p + 1:]): line_dedup._variants(short[:p] + short[p + 1:], 1, 1)[0][0] for p in range(7)}
    hashes, places = line_dedup._variants(short, 1, 1)
    assert [h for h in hashes[1:]] == [whole[tuple(short[:p] + short[p + 1:])] for p in places[1:]]
