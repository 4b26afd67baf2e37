"""Operators 11 to 13 against brute force on small tables, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suasion.llm import chat_format, lexical_search, structure_repair
from suasion.llm.queries import CONTROL_TEXT, REGISTRY
from suasion.llm.shared import ready

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


@pytest.mark.parametrize("key", ["op11_lexical_search", "op12_chat_format", "op13_structure_repair"])
def test_query_equals_its_sql(sp, key):
    query, sql = REGISTRY[key]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = query(sp, SF)
    want = con.sql(sql)
    order = {n: i for i, n in enumerate(want.columns)}
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(str(r[c]) for c in sorted(order)) for r in got.collect())
    assert rows == sorted(tuple(str(r[order[c]]) for c in sorted(order)) for r in want.fetchall()) and rows


# 11 --------------------------------------------------------------------------------
def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in items:
        found = []
        for place, (doc, c) in enumerate(docs):
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                df = sum(t in other for _, other in docs)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, r + 1, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def search(sp, docs, items, k=10):
    d = sp.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, rank int").repartition(3)
    q = sp.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, query string")
    out = lexical_search.search(lexical_search.build_index(d), q, k)
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()]


def test_search_equals_brute_force(sp, monkeypatch):
    monkeypatch.setattr(lexical_search, "DICTIONARY_TERMS", 64)  # several dictionaries a task
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)  # several blocks
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "été", "日本", "A1", "ÄB", "x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", "-", "\n", "_", "."]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 200]))) for i in range(180)] + [(500, "w1 " * 5000 + text(900)), (501, None), (502, ""), (503, "...")]
    docs += [(600 + i, "w7 w9 x") for i in range(15)] + [(None, "w7 w9 x"), (601, "w7 w9 x")]  # ties
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(20)] + [(30, "w7 w9"), (31, None), (32, "??"), (33, "nowhere"), (30, "w7 w9"), (None, "x X x")]
    got, want = search(sp, docs, items), brute_search(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    many = search(sp, docs, [(1, "w7 w9 x")], 40)
    assert sorted(many, key=str) == sorted(brute_search(docs, [(1, "w7 w9 x")], 40), key=str)


def test_search_of_nothing(sp):
    assert search(sp, [], [(1, "a")]) == [] == search(sp, [(1, "a b")], []) == search(sp, [(1, None)], [(1, "a")])


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.binary(min_size=1, max_size=6), st.integers(1, 3000), min_size=1, max_size=80))
def test_sketch_never_understates(counts):
    bits, sketch = lexical_search.sketch_of(counts)
    codes = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts))
    first, second = lexical_search.coordinates(codes, bits)
    most = lexical_search._MOST[np.minimum(sketch[first], sketch[second])]
    assert (most >= np.array(list(counts.values()))).all() and sketch.size >= 4 * len(counts)


# 12 --------------------------------------------------------------------------------
PART = ("kind", "text", "uri", "width", "height", "seconds", "pages")
CHAT = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, mask string, formatted int"


def part(**values):
    return tuple(values.get(n) for n in PART)


def chat(sp, rows):
    return chat_format.format_chat(sp.createDataFrame([(*r, "m", 1) for r in rows], CHAT))


def test_parts_flatten_to_placeholders(sp):
    parts = [part(kind="text", text="look: "), part(kind="image", uri="s3://a/1.png", width=29, height=14), part(kind="text", text=" and <"),
             part(kind="text", text="|turn|> "), part(kind="audio", uri="a.wav", seconds=1.5), part(kind="document", uri="d.pdf", pages=2),
             part(kind="video", uri="v.mp4"), None, part(kind="image")]
    row = chat(sp, [(1, 0, "assistant", parts)]).first()
    assert [tuple(a) for a in row["attachments"]] == [(2, "image", "s3://a/1.png", 3), (5, "audio", "a.wav", 38), (6, "document", "d.pdf", 2048),
                                                      (7, "other", "v.mp4", 0), (9, "image", None, 0)]
    assert row["n_tokens"] == 3 + 38 + 2048 + 1 + 2 + 1
    turns = chat_format.parsed(row["formatted"])
    assert turns == [("assistant", [("text", "look: "), ("image", 2), ("text", " and <|turn|> "), ("audio", 5), ("document", 6), ("other", 7), ("image", 9)])]
    at, loss = 0, ""
    for r in row["mask"]:
        piece = row["formatted"][at:at + r["chars"]]
        loss += chat_format.unescaped(piece) if r["loss"] else ""
        at += r["chars"]
    assert at == len(row["formatted"]) and loss == "look:  and <|turn|> "


def test_texts_come_back(sp):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["<", "|", "\\", "turn", "/", ">", "<|turn|>", "<|/turn|>\n", "\n", "n", "😀", "\r", "<|image:1|>", "\x85"], k=rng.randrange(12)))
             for _ in range(400)] + [CONTROL_TEXT, "", "\\", "<", "<\\", "\\n"]
    roles = ["user", "assistant", "a\nb", "<|turn|>", "\\", "<", "", None, "x\\n"]
    rows = [(i // 7, i % 7, roles[i % len(roles)] if i % 3 else "assistant", [part(kind="text", text=t[:k]), part(text=t[k:])])
            for i, t in enumerate(texts) for k in [rng.randrange(len(t) + 1)]]
    made = chat(sp, rows)
    got = {(r["conv_id"], r["turn"]): chat_format.parsed(r["formatted"]) for r in made.collect()}
    for (conv, turn, role, _), text in zip(rows, texts, strict=True):
        (back_role, parts), = got[conv, turn]
        assert (back_role, "".join(x for _, x in parts)) == (role or "", text)
    want = defaultdict(lambda: [0, "", ""])
    for (conv, _, role, _), text in zip(rows, texts, strict=True):
        w = want[conv]
        want[conv] = [w[0] + 1, w[1] + f"{role or ''}\n{text}\n", w[2] + (text if role == "assistant" else "")]
    for r in chat_format.read_back(made).collect():
        n, turns, loss = want.pop(r["conv_id"])
        assert (r["n_turns"], r["turns_sha256"]) == (n, hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not want


def test_chat_of_nothing(sp):
    assert chat(sp, []).count() == 0 and chat_format.read_back(chat(sp, [])).count() == 0
    row = chat_format.read_back(chat(sp, [(None, None, None, None)])).first()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (None, 1, 0)
    assert row["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and row["loss_sha256"] == hashlib.sha256().hexdigest()


# 13 --------------------------------------------------------------------------------
REPAIRED = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """Cheapest audit of (role, text, must_go, cut) rows, ASCII-least among ties, with whole strings: every
    role sequence of edits, at most two inserts in a row."""
    cells = {"": (0, "", "")}  # the state's regular prefix class, by the last two initials

    def after(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    def inserts(cells):
        for _ in range(2):
            for state, (cost, audit, out) in list(cells.items()):
                for role in ("user", "assistant"):
                    to = after(state, role[0])
                    if to is not None:
                        new = (cost + 2, audit + "I", f"{out}\n{role}:")
                        cells[to] = min(cells.get(to, new), new)
        return cells
    cells = inserts(cells)
    for role, text, must_go, cut in rows:
        fresh = {}

        def offer(state, *new):
            fresh[state] = min(fresh.get(state, new), new)
        for state, (cost, audit, out) in cells.items():
            offer(state, cost + 3, audit + "D", out)
            if not must_go:
                if after(state, role[:1]) is not None:
                    offer(after(state, role[:1]), cost + cut, audit + "K", f"{out}\n{role}:{text}")
                for new in ("user", "assistant"):
                    if after(state, new[0]) is not None:
                        offer(after(state, new[0]), cost + 2 + cut, audit + "R", f"{out}\n{new}:{text}")
        cells = inserts(fresh)
    best = min(cells[s] for s in ("", "a") if s in cells)
    return best[0], best[1], best[2][1:]


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", " ", "unknown"]), st.sampled_from(["a.", "b", ""]), st.booleans(), st.booleans())


def run_repair(rows, every=256):
    out = []
    old, structure_repair.DECIDE_EVERY = structure_repair.DECIDE_EVERY, every
    try:
        r = structure_repair.Repair(lambda *edit: out.append(edit))
        for row in rows:
            r.add(*row)
        return r.end(), "".join(e[0] for e in out), "\n".join(f"{role}:{text}" for e, role, text in out if e != "D")
    finally:
        structure_repair.DECIDE_EVERY = old


@settings(max_examples=300, deadline=None)
@given(rows=st.lists(ROW, max_size=30), every=st.sampled_from([1, 3, 256]))
def test_repair_equals_whole_strings(rows, every):
    assert run_repair(rows, every) == plain_repair(rows)


@settings(max_examples=100, deadline=None)
@given(rows=st.lists(ROW, max_size=25))
def test_repair_with_colliding_hashes(rows):
    old, structure_repair.MODULUS = structure_repair.MODULUS, 2
    try:
        assert run_repair(rows) == plain_repair(rows)
    finally:
        structure_repair.MODULUS = old


def test_repair_is_cheapest_of_all_edits():
    """Every edit of up to three rows, no DP."""
    def all_edits(rows, spelled, audit, cost):
        if REPAIRED.fullmatch(spelled) and not rows:
            yield cost, audit
        if len(spelled) <= 6 and audit[-2:] != "II":
            for x in "ua":
                yield from all_edits(rows, spelled + x, audit + "I", cost + 2)
        if rows:
            (role, _, must_go, cut), rest = rows[0], rows[1:]
            yield from all_edits(rest, spelled, audit + "D", cost + 3)
            if not must_go:
                yield from all_edits(rest, spelled + role[:1], audit + "K", cost + cut)
                for x in "ua":
                    yield from all_edits(rest, spelled + x, audit + "R", cost + 2 + cut)
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        assert run_repair(rows)[:2] == min(all_edits(rows, "", "", 0))


def test_long_conversation_is_decided_as_it_goes():
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.random() < 0.1, rng.random() < 0.1) for i in range(20_000)]
    held = []
    r = structure_repair.Repair(lambda *edit: None)
    for row in rows:
        r.add(*row)
        held.append(len(r.waiting))
    assert max(held) <= 4 * structure_repair.DECIDE_EVERY
    assert run_repair(rows[:3000]) == plain_repair(rows[:3000])


def test_prefixes_are_found_by_climbing():
    rng = random.Random(1)
    nodes = [structure_repair.Node(None, "")]
    for _ in range(300):
        nodes.append(structure_repair.Node(rng.choice(nodes[-20:]), rng.choice("DK")))
    leaf = {n.text(): n for n in nodes}
    texts = sorted(leaf)
    assert [n.ancestor(d).text() for n in nodes[-3:] for d in range(n.depth)] == [n.text()[:d] for n in nodes[-3:] for d in range(n.depth)]
    for a, b in zip(texts, texts[1:], strict=False):
        assert structure_repair.less(leaf[a], "", leaf[b], "") and not structure_repair.less(leaf[b], "", leaf[a], "")


def test_audits_of_rows(sp):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", "So"), (1, 3, "assistant", "So"), (1, None, "system", " \t"),
            (None, 0, None, None), (2, None, "user", "a!"), (3, 5, "assistant", "x?")]
    df = sp.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, first string").repartition(4)
    got = {r["conv_id"]: r for r in structure_repair.audits(df).collect()}
    r = got[1]
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (1, 1, 2, 1, 2, 10, "DKDKD")
    assert r["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:So").hexdigest()
    assert (got[None]["blank"], got[None]["audit"], got[None]["cost"]) == (1, "D", 3)
    assert (got[2]["gaps"], got[2]["audit"]) == (0, "KI") and got[3]["audit"] == "IK"
    lines = structure_repair.repaired_rows(df).orderBy("conv_id", "place").collect()
    assert [tuple(x) for x in lines] == [(1, 0, "K", "user", "Hi."), (1, 1, "K", "assistant", "So"), (2, 0, "K", "user", "a!"), (2, 1, "I", "assistant", ""),
                                         (3, 0, "I", "user", ""), (3, 1, "K", "assistant", "x?")]
    gone = structure_repair.audits(df.where("conv_id = 2"), present=F.lit(False)).collect()
    assert [tuple(x) for x in gone] == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert structure_repair.audits(df.limit(0)).count() == 0 == structure_repair.damaged(df.limit(0)).count()


def test_damage_follows_the_code(sp):
    rows = [(i % 40, i // 40, "assistant", "One. Two!") for i in range(400)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in structure_repair.damaged(sp.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"], r["present"]))
    want = {0: [("assistant", "", False)], 1: [("assistant", "", True)], 2: [("assistant", "One Two", True)], 3: [("assistant", "One. Two!", True)] * 2,
            4: [("user", "One. Two!", True)]}
    for conv, turn, _, text in rows[:-1]:
        assert got[conv, turn] == want.get(zlib.crc32(f"{conv}:{turn}".encode()) % 20, [("assistant", text, True)])
    assert got[None, None][0][1] in (" ", "") and zlib.crc32(b" : ") % 20 > 4 and got[None, None] == [(" ", " ", True)]


# 5, on markup that the given pages lack ----------------------------------------------
SENTENCE = "A sentence with just as many words as a paragraph of an article may well have in it. "
ARTICLE = f"<p>{SENTENCE * 3}</p><p>{SENTENCE * 4}</p><p>It ends with these six words.</p>"


@pytest.fixture(scope="module")
def block_tree(sp):
    from suasion.llm import html_text
    return html_text.fit(sp)


@pytest.mark.parametrize("page", [
    '<nav><a>x</a></nav><article class="post has-sidebar">{}</article><footer>f</footer>', '<div class="content with-sidebar">{}</div>',
    '<main class="no-sidebar">{}</main>', '<article class="social-science">{}</article>', '<form id="f"><article>{}</article></form>',
    '<nav><a href="x">Home</a><a>B</a><article>{}</article>', '<article>{}</article><form><p>Log in to read more of these fine texts.</p></form>',
    '<article>{}</article><div id="comments"><article class="comment-body"><p>' + SENTENCE * 9 + "</p></article></div>",
    '<form><nav><a>x</a></nav><article>{}</article><aside class="related"><p>' + SENTENCE + "</p></aside></form>"])
def test_main_text_survives_odd_markup(block_tree, page):
    from suasion.llm import html_text
    want = "\n\n".join([(SENTENCE * 3).strip(), (SENTENCE * 4).strip(), "It ends with these six words."])
    assert html_text.main_text(page.replace("{}", ARTICLE), block_tree) == want


def test_counts_and_links_decide_without_tags(block_tree):
    from suasion.llm import html_text
    links = "".join(f'<div><a href="{i}">Go to page {i}</a></div>' for i in range(6))
    last = "<p>One last paragraph of sixteen words that stands here at the very end of the page.</p>"
    body = "".join(f"<p>{SENTENCE * k}</p>" for k in (3, 2, 4))
    got = html_text.main_text(f"<body>{links}{body}{last}{links}</body>", block_tree)
    assert got == "\n\n".join([*[(SENTENCE * k).strip() for k in (3, 2, 4)], html_text.blocks(last)[0][0]])
    form = html_text.main_text(f'<form id="aspnetForm">{links}{body}{last}</form>', block_tree)
    assert form == got  # a form round the whole page is no furniture
