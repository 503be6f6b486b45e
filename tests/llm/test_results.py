"""The registered queries against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstile.llm import catalog, html, lattice, lm
from turnstile.llm.fingerprints import Fingerprint
from turnstile.llm.packing import Limits, WordTokenizer, pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return [r.asDict() for r in catalog.queries()[name](spark, SF).collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    rows = run(spark, "op1_packing")
    at, used = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {k: len(v) for k, v in ids.items()}
    for spans in used.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end == 4096 or end & (end - 1) == 0


def test_packing_keeps_every_limit():
    rng = random.Random(1)
    n = [rng.randint(0, 900) for _ in range(300)]
    loss = [rng.randint(0, x) for x in n]
    lim = Limits(tokens=1000, segments=5, loss_tokens=400)
    got = pack([min(x, 1000) for x in n], [min(y, 400) for y in loss], lim, cut=False)
    per = {}
    for p in got:
        per.setdefault(p.sequence, []).append(p)
    assert Counter(p.item for p in got) == Counter(i for i, x in enumerate(n) if x)
    for ps in per.values():
        assert sum(p.length for p in ps) <= 1000 and len(ps) <= 5 and sum(min(loss[p.item], 400) for p in ps) <= 400
    cut = pack(n, loss, lim)
    assert Counter({i: x for i, x in enumerate(n) if x}) == sum((Counter({p.item: p.length}) for p in cut), Counter())
    for s in {p.sequence for p in cut}:
        assert sum(1 for p in cut if p.sequence == s) <= 5
    with pytest.raises(ValueError):
        pack([1001], None, lim, cut=False)


def test_packing_by_loss_differs_from_longest_first(spark):
    """Two long examples of little loss and many short ones full of it: the dot product saves the scarcer room."""
    n, loss = [500] * 4 + [300] * 8, [10] * 4 + [300] * 8
    lim = Limits(tokens=1000, segments=50, loss_tokens=600)
    got = pack(n, loss, lim, cut=False)
    longest = pack(n, [0] * 12, lim, cut=False)
    assert [p.item for p in got] != [p.item for p in longest]
    assert {p.sequence for p in got if p.item < 4} != {p.sequence for p in longest if p.item < 4}

    from turnstile.llm import packing

    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    lim = Limits(tokens=1024, segments=8, loss_tokens=400)
    rows = packing.pack_conversations(spark, turns, limits=lim).collect()
    tok = packing.tokenizer(None)
    size, bear = Counter(), Counter()
    for t in turns.collect():
        m = len(tok.ids(t["text"] or "")) // 4 + 1
        size[t["conv_id"]] += m
        bear[t["conv_id"]] += m * (t["role"] == "assistant")
    per, total = {}, Counter()
    for r in rows:
        per.setdefault(r["sequence_id"], []).append(r)
        total[r["doc_id"]] += r["length"]
    assert total == size
    for rs in per.values():
        assert len(rs) <= 8 and sum(bear[r["doc_id"]] / size[r["doc_id"]] * r["length"] for r in rs) <= 400 + len(rs)


def test_other_tokenizer_files(spark):
    import public_tokenizers
    from turnstile.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = WordTokenizer(path)
    for s in ["It's  TWO\n words", "Ünïcödé  x"]:
        assert np.frombuffer(t.ids(s), "<u4").tolist() == t.tok.encode(s, add_special_tokens=False).ids
    assert not t.by_word and packing.tokenizer(None).by_word


def test_tokenizer_agrees_on_odd_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = WordTokenizer(path)
    for s in ["It's 3 o'clock!! <|endoftext|> x", "ΣΑΣ İ ǅ ﬁ é  nb", "日本語 текст", "a\x1cb\x85c", "", "   ", "Ünïcödé'll"]:
        assert np.frombuffer(t.ids(s), "<u4").tolist() == t.tok.encode(s, add_special_tokens=False).ids


def test_lm_base_scores_and_gain(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op2_lm")}
    tok = {k: [*lower(t).encode().split(), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = Counter(w for k, ws in tok.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tok.items():
        r = rows[k]
        base = sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    # Against symbols by their own frequencies: longer contexts must help on texts that weren't learnt.
    out = [r for r in rows.values() if r["held_out"]]
    letters = Counter(x for r in out for x in b" ".join(lower(texts[r["doc_id"]]).encode().split()) + b"\n")
    flat = sum(k * math.log10(k / sum(letters.values())) for k in letters.values())
    assert sum(r["score"] for r in out) > 0.75 * flat


def test_lm_reads_six_bytes_of_context(spark):
    rows = [(k, " ".join(f"{c}bcdef{d}" for c, d in ("au", "gv", "hw", "ix") * 20)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda **how: sum(r["score"] for r in lm.score_documents(spark, df, **how).collect() if r["held_out"])
    assert total() == pytest.approx(total(order=6)) and total() > 0.5 * total(order=5)


def symbols(text):
    return b" ".join(lower(text).encode().split()) + b"\n"


class Trie:
    """Static prediction by partial matching from plain dictionaries of contexts."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            raw = b"\n" * order + symbols(t)
            for i in range(order, len(raw)):
                for m in range(order + 1):
                    self.seen.setdefault(raw[i - m : i], Counter())[raw[i]] += 1

    def p(self, past, s):
        out, gone = 1.0, set()
        for m in range(self.order, -1, -1):
            own = self.seen.get(past[len(past) - m :], {})
            live = {k: v for k, v in own.items() if k not in gone}
            if not live:
                continue
            total = 2 * sum(live.values())
            if s in live:
                return out * (2 * live[s] - 1) / total
            out *= len(live) / total
            gone = set(own)
        return out / (256 - len(self.seen.get(b"", {})))

    def score(self, text):
        raw = b"\n" * self.order + symbols(text)
        return sum(math.log10(self.p(raw[i - self.order : i], raw[i])) for i in range(self.order, len(raw)))


@pytest.mark.parametrize("order", [3, 6])
def test_lm_scores_against_plain_dictionaries(spark, texts, order):
    some = dict(sorted(texts.items())[:25]) | {10**6: "zq\x01 xj\u00ff", 10**6 + 5: None}
    trie = Trie([t for k, t in some.items() if zlib.crc32(str(k).encode()) % 7 != 2], order)
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark, df, order=order).collect()}
    assert got == {k: pytest.approx(trie.score(t), rel=1e-9) for k, t in some.items()}


def test_lm_probabilities_add_up(spark, texts):
    trie = Trie(list(texts.values())[:30], 3)
    for past in (b"the", b"\n\n\n", b"zzz", b"\xc3\xa9 "):
        assert sum(trie.p(past, s) for s in range(256)) == pytest.approx(1.0, abs=1e-9)
    assert lm.adaptive_code_length("abababababababab") > lm.adaptive_code_length("qwmznxbvlaksjdhf")


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op3_fingerprints")}
    ids = sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        t, nxt = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert rows[k]["n_chars"] == len(t) and rows[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert rows[k]["fingerprint"] == Fingerprint.of(t).text() and rows[k]["edited_fingerprint"] == Fingerprint.of(e).text()
    same = {}
    for k, t in texts.items():
        assert same.setdefault(t, rows[k]["fingerprint"]) == rows[k]["fingerprint"]
    long = [r for r in rows.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97


def test_fingerprints_by_ranges(spark):
    from turnstile.llm import fingerprints

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(fingerprints.fingerprints(spark, docs, rows_per_bucket=n).collect()) for n in (10_000, 7))
    assert one == many


def test_fingerprints_are_homomorphic():
    a, b, c = "first paragraph of some length", "second one, quite different", "third\ttoo"
    whole = Fingerprint.of(f"{a}\n{b}\n{c}")
    assert whole == Fingerprint.of(f"{c}\n{a}\n{b}") == Fingerprint.of(a) + Fingerprint.of(b) + Fingerprint.of(c)
    assert whole - Fingerprint.of(b) == Fingerprint.of(f"{a}\n{c}") and Fingerprint.parse(whole.text()) == whole
    assert whole != Fingerprint.of(f"{a}\n{b}\n{b}")


def test_fingerprints_of_very_repetitive_texts():
    line = "one line of thirty-two bytes....\n"
    half, whole, more = (Fingerprint.of(t) for t in (line * 32_768, line * 65_536, line * 65_536 + "and six words that are new"))
    assert whole.likeness(half) >= 0.99 and whole.likeness(more) >= 0.99 and whole != half
    assert Fingerprint.parse(whole.text()) == whole == half + half - Fingerprint.of("")


def test_near_duplicates(spark, texts):
    sets = {}
    for k, t in texts.items():
        w = lower(t).encode().split()
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    label = {k: k for k in sets}
    for _ in range(10):
        for k, s in sets.items():
            for j, o in sets.items():
                i = len(s & o)
                if i and 100 * i >= 85 * (len(s) + len(o) - i):
                    label[k] = label[j] = min(label[k], label[j])
    for r in run(spark, "op4_neardup"):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_in_blocks(spark):
    """A group larger than a block is compared whole."""
    from turnstile.llm import neardup

    base = [f"w{i}" for i in range(60)]
    data = [(k, " ".join([*base[:-1], f"x{k}"])) for k in range(40)] + [(100, "something else entirely here")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.linked(spark, spark.createDataFrame(data, "doc_id long, text string"), words=3, threshold=0.8, block=8).collect()}
    assert got == {**{k: 0 for k in range(40)}, 100: 100}


def test_substrings(spark, texts):
    w = {k: (texts[k] or "").encode().split() for k in sorted(texts)}
    first = {}
    for k, ws in w.items():
        for i in range(len(ws) - 12):
            first.setdefault(tuple(ws[i : i + 13]), k)
    for r in run(spark, "op5_substring"):
        ws = w[r["doc_id"]]
        gone = [False] * len(ws)
        for i in range(len(ws) - 12):
            if first[tuple(ws[i : i + 13])] < r["doc_id"]:
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(ws, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())


def test_embeddings(spark):
    """Links planted at many cosines: none below 0.9, nearly all above, exact ids of components."""
    from turnstile.llm import embeddings

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    more = []
    for v in x:
        for c in (0.89, 0.9001, 0.92, 0.97):
            z = rng.standard_normal(64)
            z -= (z @ v) * v
            more.append(c * v + math.sqrt(1 - c * c) * z / np.linalg.norm(z))
    x = np.concatenate([x, more, x[:10]])
    got = {r["vec_id"]: r for r in embeddings.linked(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), block=50).collect()}
    true = (x @ x.T) >= 0.9
    np.fill_diagonal(true, False)
    found, want = sum(r["n_links"] for r in got.values()), int(true.sum())
    assert want * 0.95 <= found <= want
    assert all(got[i]["n_links"] <= true[i].sum() for i in got)
    # Pairs well above the threshold are all found, and components never join what no chain of links joins.
    label = {True: np.arange(len(x)), False: np.arange(len(x))}
    for sure in label:
        linked = (x @ x.T) >= (0.95 if sure else 0.9)
        for _ in range(len(x)):
            new = np.where(linked, label[sure], len(x)).min(1)
            if (new == label[sure]).all():
                break
            label[sure] = new
    for i, r in got.items():
        assert label[False][i] <= r["component_id"] <= label[True][i] and r["kept"] == (r["component_id"] == i)


@pytest.mark.parametrize(("vectors", "least"), [(1_000, 0.97), (1_000_000, 0.96), (10**8, 0.96)])
def test_embedding_settings_find_close_pairs(vectors, least):
    from turnstile.llm import embeddings

    rng = np.random.default_rng(3)
    x, z = (embeddings.unit(rng.standard_normal((1500, 64))) for _ in range(2))
    z = embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(0.19) * z
    how, met = embeddings.setting_for(vectors), np.zeros(len(x), bool)
    for t in range(how.tables):
        (hx, sx), (hy, sy) = (embeddings.cells(v, t, how) for v in (x, y))
        met |= (hx == hy) | (sx == hy[:, None]).any(1) | (sy == hx[:, None]).any(1)
    assert met.mean() >= least


def test_embedding_links_are_the_same_for_any_number_of_rows(spark, monkeypatch):
    """Pairs of cosine 0.9 and little more; a table that says it has 3,000,000 rows has the same links."""
    from turnstile.llm import embeddings

    rng = np.random.default_rng(8)
    x, z = (embeddings.unit(rng.standard_normal((700, 64))) for _ in range(2))
    z = embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    v = np.concatenate([x, 0.9001 * x + math.sqrt(1 - 0.9001**2) * z])
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    small = sorted(embeddings.linked(spark, df).collect())
    monkeypatch.setattr(type(df), "count", lambda self: 3_000_000)
    assert sorted(embeddings.linked(spark, df).collect()) == small
    assert sum(r["n_links"] for r in small) >= 2 * 0.98 * 700


def test_lattice_decoding():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((200, 8)) * 2
    home = lattice.decode(y)
    near = lattice.neighbours(y, home, 240)
    d = ((2 * y - home) ** 2).sum(1)
    assert (d[:, None] <= ((2 * y[:, None, :] - near) ** 2).sum(2) + 1e-9).all()  # no neighbour is nearer
    assert (home.sum(1) % 4 == 0).all() and ((home % 2 == 0).all(1) | (home % 2 == 1).all(1)).all()


def test_pages(spark):
    rows = {r["page_id"]: r for r in run(spark, "op7_html")}
    import html as entities

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        h = r["html"]
        a, b = h.find("<article>"), h.find("</article>")
        x = re.sub(r"<[^>]*>", " ", h[a + 9 : b if b >= 0 else len(h)])
        got = rows[r["page_id"]]
        assert got["text"].split() == entities.unescape(x).split() and got["n_chars"] == len(got["text"]) and got["url"] == r["url"]


def test_wrappers_leave_chrome_out():
    page = """<html><body class="page"><header>Site</header><div id="cookie-notice">We use cookies</div><div class="row"><div class="sidebar">Links</div>
      <div class="content"><h2>Title</h2><p>One &lt;two&gt; <b>th</b>ree</p><p>Four<ul><li>a<li>b</ul><form><input value=1>Name</form><section class="comments"><p>Nice!</p></section></div></div>
      <script>if (a < b) document.write("<p>no</p>")</script><footer>&copy;</footer></body></html>"""
    assert html.extract(page, None) == "Title One <two> three Four a b"
    e = html.expression(html.parse(page))
    assert html.align(e, e) == e
    other = html.expression(html.parse(page.replace("<h2>Title</h2>", "")))
    assert any("?" in str(x) for x in html.align(e, other))
    runs = html.expression(html.parse("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p></div>"))
    assert runs[0][2][0][:2] == ["(", "+"]


def pages_of(spark, htmls, url="http://h.example/"):
    df = spark.createDataFrame([(k, url + str(k), h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html.main_texts(spark, df).collect(), key=lambda r: r["page_id"])]


def test_wrapper_tells_template_slots(spark):
    page = "<body><article><h1>T{0}</h1><ul><li>Home<li>About us</ul><p>Text {0}</p><div class='x'>Always here</div>{1}</article></body>"
    htmls = [page.format(k, "<h6>Seldom</h6>" if k < 3 else "") for k in range(8)]
    want = [f"T{k} Text {k}" + (" Seldom" if k < 3 else "") for k in range(8)]
    assert pages_of(spark, htmls) == want  # constant on 3 of 8 pages and optional: kept
    assert pages_of(spark, htmls[:1] * 5) == ["T0 Home About us Text 0 Always here Seldom"] * 5  # copies of one page


def test_wrapper_finds_the_text_without_article_and_class_names(spark):
    """Menu, text, advert and footer in elements of the same meaningless name: only the wrapper tells them apart."""
    head = "<div class=q><ul><li>Start<li>Stories<li>Shop</ul></div>"
    foot = "<div class=q><table><tr><td>Made by us<td>All rights</table></div>"
    body = "<html><body><div class=a>{0}<div class=q><h2>Title {1}</h2><p>First words of {1}</p><p>More of {1}</p></div>{2}</div></body></html>"
    htmls = [body.format(head if k != 3 else "", f"page{k}", foot) for k in range(8)]
    want = [f"Title page{k} First words of page{k} More of page{k}" for k in range(8)]
    assert pages_of(spark, htmls) == want
    assert all("Made by us" in html.extract(h, None) for h in htmls)  # without the wrapper


def test_alignments_of_any_length_are_longest():
    """As a plain table of lengths gives them, for short runs of siblings and for runs of more than 500."""

    def plain(a, b):
        n, m = len(a), len(b)
        again = {x[0] for items in (a, b) for x in items if sum(y[0] == x[0] for y in items) > 1}
        hit = lambda i, j: a[i][0] == b[j][0] and (a[i][0] not in again or html._alike(a[i], b[j]))
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if hit(i, j) else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n and j < m:
            if hit(i, j):
                out, i, j = [*out, (i, j)], i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    rng = random.Random(4)
    item = lambda name: [name, "", [[c, "", [], []] for c in rng.sample("uvwxyz", rng.randrange(4))], []]
    for size, names, rounds in ((9, 3, 200), (40, 6, 20), (560, 30, 1)):
        for _ in range(rounds):
            # The ends differ, so that nothing but the table decides.
            a, b = ([[f"{side}0", "", [], []], *(item(f"n{rng.randrange(names)}") for _ in range(rng.randrange(size - size // 9, size))), [f"{side}1", "", [], []]] for side in "ab")
            assert html.pairs(a, b) == plain(a, b)
    a = [[f"n{k}", "", [], []] for k in range(600)]
    b = [*([f"m{k}", "", [], []] for k in range(80)), *a, ["end", "", [], []]]
    assert html.pairs(a, b) == [(k, 80 + k) for k in range(600)]


def test_deep_pages():
    deep = "<div>" * 5000
    assert html.extract(f"<nav>Menu</nav>{deep}<p>Text</p><aside>Aside <b>more</b></aside>", None) == "Text"
    assert html.extract(f"{'<div>' * 400}<nav>{deep}Menu<p>Menu</p></nav><p>Text", None).endswith("Text")
    wide = "".join(f"<p>a{k}</p><h2 class=c{k % 7}>b</h2><ul><li>c</ul>" * (k % 3) for k in range(4000))
    e = html.expression(html.parse(wide))
    assert html.align(e, html.expression(html.parse("<h1>x</h1>" + wide)))
    own, found = html.outline(html.parse(wide))
    assert min(html.matched(html.numbered(e), own, len(found))) >= 0


def test_chrome_words_spare_the_text():
    text = "<p>" + "word " * 30 + "</p>"
    want = ("word " * 30).strip()
    for tag in ('div class="layout has-sidebar"', 'div id="content-with-comments"', 'form id="aspnetForm"'):
        end = tag.split()[0]
        assert html.extract(f"<body><nav>Menu</nav><{tag}><article>{text}</article></{end}></body>", None) == want
        assert html.extract(f"<body><nav>Menu</nav><{tag}><div class=sidebar>Links</div>{text}</{end}></body>", None) == want
    for name in ("alert", "notice", "legal", "discussion", "related", "social"):
        assert html.extract(f"<article>{text}<div class={name}>Real</div><div class=ad>Buy</div></article>", None) == want + " Real"


def test_unclosed_raw_elements_keep_the_text():
    assert html.extract("<article><p>One <svg width='1'/> two</p><p>Three</p><svg><text>no</text></svg><p>Four</p></article>", None) == "One two Three Four"
    for tag in ("svg", "template", "noscript"):
        assert html.extract(f"<article><p>One</p><{tag}><p>Two</p></article>", None) == "One Two"
    assert html.extract("<article><p>One</p><script>no <p>no", None) == "One"


def test_all_sibling_articles_are_text(spark):
    both = "<body><article class='post news'><p>Lead</p></article><article class='post sports'><p>Body of it</p></article><div>Else</div></body>"
    assert html.extract(both, None) == "Lead Body of it"
    assert html.extract("<main><p>Intro</p><article><p>Text</p></article></main>", None) == "Intro Text"
    one = "<body><article class='post sports'><p>Only {}</p></article></body>"
    assert pages_of(spark, [both, one.format(1), one.format(2)]) == ["Lead Body of it", "Only 1", "Only 2"]


def test_mixing_targets(spark):
    rows = run(spark, "op8_mixing")
    src = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    df = pd.DataFrame(rows)
    df["src"] = df["doc_id"].map(src)
    by = df.groupby("src").agg(size=("size", "sum"), one=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["one"]).all() and (df["taken"] <= 2 * df["size"]).all()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index, key=lambda s: s.encode()))}
    goal, open_, left = {}, set(by.index), 1.5 * by["size"].sum()
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 2 * by["size"][s]}
        if not over:
            goal |= {s: left * weights[s] / total for s in open_}
            break
        goal |= {s: 2.0 * by["size"][s] for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    assert by["target"].to_dict() == pytest.approx(goal)
    assert ((by["taken"] - by["target"]).abs() <= np.maximum(0.02 * by["target"], 70)).all()
    again = pd.DataFrame(run(spark, "op8_mixing"))
    assert sorted(zip(df.doc_id, df.taken, df.shards)) == sorted(zip(again.doc_id, again.taken, again.shards))


def test_mixing_draws_the_shards(spark):
    """A shard's counts follow its draws: multinomial about the sources' shares, other ones with another seed."""
    from turnstile.llm import mixing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    drawn = {}
    for seed in (1, 2):
        m = mixing.mix(spark, docs, shard_slots=256, seed=seed)
        slots = m.slots.toPandas()
        goal = m.rows.groupBy("sk").agg(F.first("slots").alias("n")).toPandas().set_index("sk")["n"]
        assert slots.groupby("sk").size().to_dict() == goal[goal > 0].to_dict()
        assert not slots.duplicated(["sk", "idx", "pass"]).any()
        counts = slots.pivot_table(index="shard", columns="sk", values="idx", aggfunc="size", fill_value=0)
        share = goal / goal.sum()
        sizes = counts.sum(axis=1)
        assert len(sizes) == -(-int(goal.sum()) // 256)
        chi = (((counts - np.outer(sizes, share[counts.columns])) ** 2) / np.outer(sizes, share[counts.columns])).to_numpy().sum()
        free = (counts.shape[0] - 1) * (counts.shape[1] - 1)
        assert abs(chi - free) < 5 * math.sqrt(2 * free)
        drawn[seed] = counts
    assert not drawn[1].equals(drawn[2])


def auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    y = np.asarray(y)
    p, n = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality", "quality", 0.98), ("op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"  # some thousands of labels
    got = catalog.queries()[name](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert auc(held.score, held[label]) >= least
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(texts)


def test_pipeline_works_on_small_chunks(spark, monkeypatch):
    """A task of substring dedup holds 2 MB of text at a time, and rows are those of chunks of any size."""
    import corpus_pipeline
    from turnstile.llm import substring

    rng, sizes, pack = random.Random(2), [], substring.pack

    def packed(*args, **more):
        out = pack(*args, **more)
        sizes.extend(sum(r["lens"]) for r in out.select("lens").collect())
        return out

    docs = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))) for k in range(450)]
    docs += [(450 + k, t[:200]) for k, t in docs[:20]]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring, "pack", packed)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, df, SF).collect()}
    assert sum(sizes) > 3_000_000 and max(sizes) < 2.1 * 2**20
    assert got == {r["doc_id"]: r["kept"] for r in substring.remove_repeats(spark, df, rest=["doc_id"], chunk_bytes=1 << 30).collect()}
    assert all(len(got[450 + k]) < 30 for k in range(20)) and all(got[k] == t for k, t in docs[:450])
